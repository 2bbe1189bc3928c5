"""Vector tables: (id BIGINT, vector ARRAY<DOUBLE>) in, pairs (i, j, value) out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import hold


def as_vectors(df: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Columns id and vector; takes arrays of any numbers and dense or sparse ml and mllib vectors.

    Rows without an id or a vector are dropped: no join could name or compare them.
    """
    kind = df.schema[vector_col].dataType
    if isinstance(kind, T.ArrayType):
        vector = F.col(vector_col).cast("array<double>")
    elif kind.typeName() in ("vectorudt", "udt") or "VectorUDT" in type(kind).__name__:
        from pyspark.ml.functions import vector_to_array

        vector = vector_to_array(vector_col)
    else:
        raise TypeError(f"{vector_col} is {kind.simpleString()}, not a vector")
    return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")


def width(df: DataFrame) -> int:
    """The length of the first vector: one row is read. 0 for an empty table."""
    row = df.select(F.size("vector")).first()
    return row[0] if row else 0


def check(df: DataFrame, features: int | None = None) -> DataFrame:
    """Fails while it runs if a vector has another length than `features` (if None, than others) or an id is repeated."""
    found = df.agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"), (F.count("*") - F.countDistinct("id")).alias("again")).first()
    if found.lo is not None and (found.lo != found.hi or features not in (None, found.lo)):
        raise ValueError(f"vectors have {found.lo} to {found.hi} elements, not {features or 'one length'}")
    if found.again:
        raise ValueError(f"{found.again} ids are repeated")
    return df


def numbered(df: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """Adds `id`: 0, 1, 2 ... in the order of a column that no two rows share.

    Rows are dealt out by ranges of the column, `parts` or as many as the session has shuffle partitions, and sorted there; each range starts where the
    ones before it end. The ranges are held, since their sizes are counted first; the table of sizes has a row per range.
    """
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = df.repartitionByRange(order) if parts is None else df.repartitionByRange(parts, order)
    rows = hold(ranges.sortWithinPartitions(order).withColumns({"__part": F.spark_partition_id(), "__n": in_range}))
    starts = rows.groupBy("__part").count().select(
        "__part", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__part").withColumn("id", (F.col("__start") + F.col("__n")).cast("long")).drop("__part", "__start", "__n")


def _fields(column: str) -> list:
    f = F.filter(F.split(column, " "), lambda x: x != "")
    return [F.get(f, F.lit(0)).alias("word"), F.transform(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda x: x.cast("double")).alias("vector")]


def parse_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds word and vector to lines of a word and numbers, separated by spaces; empty fields are skipped, and empty lines."""
    return lines.select("*", *_fields(column)).where("word IS NOT NULL")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, word, vector) of text files, ids from 0 in the order of the files' names and of their lines."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return numbered(parse_text(spark.read.text(path).select("value", at.alias("__at"))), "__at").select("id", "word", "vector")


def from_indexed_row_matrix(spark: SparkSession, matrix) -> DataFrame:
    return as_vectors(spark.createDataFrame(matrix.rows.map(lambda r: (r.index, r.vector.toArray().tolist())), "id long, vector array<double>"))


def to_coordinate_matrix(pairs: DataFrame):
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    return CoordinateMatrix(pairs.select("i", "j", "value").rdd.map(lambda r: MatrixEntry(r.i, r.j, r.value)))
