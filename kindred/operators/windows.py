"""Positions in a global order, and blocks and sliding windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import hold


def with_position(df: DataFrame, order: list[str | Column], part: Column, by: list[str] | None = None) -> DataFrame:
    """Adds `pos`, from 0, in the given order among all rows, or among those equal in `by`.

    `part` is a coarse form of the order: it never falls where the order rises. Rows are numbered within
    its values, many tasks at once, and each value starts where the lower ones end. Its number of values is
    the caller's to bound; the table of starts is as large as that, times the values of `by`. The rows are read twice, so they are
    held.
    """
    by = by or []
    rows = hold(df.withColumn("__part", part))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "__part").count().select(*by, "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    n = F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order))
    joined = rows.withColumn("__n", n).join(starts, [*by, "__part"])
    return joined.withColumn("pos", (F.col("__start") + F.col("__n") - 1).cast("long")).drop("__part", "__start", "__n")


def signature_part(key: str = "sig_key", bits: int = 12) -> Column:
    """The first bits of a signature: 4096 parts at most, in the signatures' order."""
    lead = F.rpad(F.hex(F.substring(key, 1, 2)), 4, "0")
    return F.shiftrightunsigned(F.conv(lead, 16, 10).cast("int"), 16 - bits)


def with_block(df: DataFrame, size: int) -> DataFrame:
    """Adds `block`: tumbling blocks of `size` positions; the last may be short."""
    if size < 2:
        raise ValueError("blocks of one row have no pairs")
    return df.withColumn("block", F.floor(F.col("pos") / size).cast("long"))


def sliding(df: DataFrame, size: int, step: int) -> DataFrame:
    """A row per position and window that holds it, with `window` counting from 0.

    Window k holds the positions from k * step on, `size` of them. A last window that is cut short stays if it holds
    a position that the one before has not.
    """
    if size < 1 or step < 1 or size == step == 1:
        raise ValueError("size and step must be positive and not both 1")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step)).cast("long")
    last = F.floor(F.col("pos") / step).cast("long")
    n = df.agg(F.max("pos").alias("end"))
    rows = df.withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    return rows.crossJoin(F.broadcast(n)).where((F.col("window") == 0) | ((F.col("window") - 1) * step + size <= F.col("end"))).drop("end")
