"""Sharding by jump consistent hashing, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep

#: The shards' parts within which rows are numbered, by two hexadecimal digits; the table of their sizes has shards * PARTS rows at most.
PARTS = 256


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of a key among `shards`, and among one more.

    The walk visits ever higher shard numbers: from b it leaps to floor((b + 1) / r), r uniform in (0, 1], and
    the last number below the count is the key's shard. With one more shard the walk is the same, and so the
    key either stays or goes to the new shard. The i-th r comes from md5(key:i). A walk rises by at least one
    a step, so shards + 1 steps always end it. Null keys count as an empty key.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))

    def step(at, i):
        draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), i.cast("string"))), 1, 7), 16, 10).cast("long")
        leap = F.floor(((at["next"] + 1) * F.lit(1 << 28)) / (draw + 1)).cast("long")
        on = F.struct(
            leap.alias("next"),
            F.when(at["next"] < shards, at["next"]).otherwise(at["shard"]).alias("shard"),
            at["next"].alias("grown"),
        )
        return F.when(at["next"] > shards, at).otherwise(on)

    zero = F.lit(0).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(0), F.lit(shards + 1)),
        F.struct(zero.alias("next"), zero.alias("shard"), zero.alias("grown")),
        step,
    )
    return F.struct(walked["shard"].cast("int").alias("shard"), walked["grown"].cast("int").alias("grown"))


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """Each row's shard and its slot there: the id, size, text_crc32, law, shard, slot, grown_shard.

    Nulls: a null id is a key like any other (the empty one); a null text has size 8 and the checksum of no
    bytes. Repeated rows and equal ids share a shard and get slots of their own. Ties: slots go by part, id, size and checksum; rows equal in
    all of them are alike. A very long text is a size and a checksum here. Other columns are not read.
    An empty table gives no rows.

    Numbering: a shard holds a share of all rows, too many for one task's window at scale. So rows are
    numbered within hashed parts of a shard, and each part starts where the parts before it end. The table of
    parts has shards * PARTS rows whatever the input, so it is broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump(F.col(id_col), shards).alias("at"),
    ).select("doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown_shard"),
             F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size")), 1, 2), 16, 10).cast("int").alias("part"))
    rows = keep(rows)  # some 40 bytes a row; the texts are read once
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "part").count().select(
        "shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = W.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("n", F.row_number().over(own))
        .join(F.broadcast(parts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("start") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard")
    )
