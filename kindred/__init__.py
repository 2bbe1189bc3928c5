"""Vector similarity joins, and their building blocks, as PySpark DataFrame plans."""
