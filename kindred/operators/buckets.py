"""Hash buckets: their sizes, and spreading large ones over salts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count()


def splits(sizes: DataFrame, percentile: float) -> DataFrame:
    """Buckets larger than the percentile of sizes, with the number of salts: size div percentile + 1.

    The percentile is a one-row aggregate, joined where it is needed: nothing is collected.
    """
    limit = sizes.agg(F.percentile_approx("count", percentile, 1000).alias("limit"))
    return sizes.crossJoin(F.broadcast(limit)).where("count > limit").withColumn("salts", F.floor(F.col("count") / F.col("limit")).cast("int") + 1).drop("count", "limit")


def _with_salts(df: DataFrame, splits: DataFrame) -> DataFrame:
    """`splits` come as store.small gives them: if few, they are broadcast, so that rows of a hot bucket do not meet before they are salted."""
    keys = [c for c in splits.columns if c != "salts"]
    return df.join(splits, keys, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))


def salted(df: DataFrame, splits: DataFrame, seed: int) -> DataFrame:
    """Each row with one salt of its bucket, by a hash of its id."""
    return _with_salts(df, splits).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("salts")).cast("int")).drop("salts")


def replicated(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Each row once for every salt of its bucket."""
    return _with_salts(df, splits).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def flip_order(id_col: str, bits: int):
    """The bits in an order that depends on the row's id: by md5(id:bit)."""
    one = lambda k: F.struct(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), k.cast("string"))).alias("h"), k.alias("k"))
    return F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), one)), lambda x: x["k"])


def with_flips(df: DataFrame, flips: int, bits: int) -> DataFrame:
    """Each row, and `flips` copies whose sig_key differs in one bit each; `flip` is the bit, -1 for the row itself."""
    if flips <= 0:
        return df.withColumn("flip", F.lit(-1))

    def run(batches):
        for batch in batches:
            column, flip = batch.column("sig_key"), batch.column("flip").to_numpy()
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(batch.num_rows, -1).copy()
            at = np.flatnonzero(flip >= 0)
            keys[at, flip[at] // 8] ^= (128 >> flip[at] % 8).astype(np.uint8)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(keys.shape[1]), len(keys), [None, pa.py_buffer(keys)])
            yield batch.set_column(batch.schema.get_field_index("sig_key"), "sig_key", flat.cast(pa.binary()))

    wide = df.withColumn("flip", F.explode(F.concat(F.array(F.lit(-1)), F.slice(flip_order("id", bits), 1, min(flips, bits)))))
    return wide.mapInArrow(run, wide.schema)


__all__ = ["flip_order", "replicated", "salted", "sizes", "splits", "with_flips"]
