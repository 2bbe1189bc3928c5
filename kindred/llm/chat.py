"""Chat formatting: of conversations logged again and again as they grew, only the longest stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, keep

#: Turns that a window numbers together; longer conversations are numbered part by part.
PART = 512


def _salted(seed: int) -> Column:
    """A hash of a turn at its place. Places matter, so the exclusive or over places is a hash of the sequence."""
    return F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, place and the rolling hashes h1 and h2 of the conversation up to there; rows of a null conversation are left out.

    Places count from 1 in the order of turn, role, text. A conversation's turns are numbered in parts of about PART
    turns; the parts' sizes and hashes, a row each, carry on from part to part. Texts are moved once, for the order, and hashes from there on.
    """
    rows = _rows(df, conv_col, turn_col, role_col, text_col).where("conv IS NOT NULL").withColumn("part", F.floor(F.col("turn") / PART).cast("long"))
    before = W.partitionBy("conv").orderBy(F.asc_nulls_first("part")).rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "role", "text")
    sizes = rows.groupBy("conv", "part").count().select(
        F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    same = (F.col("conv") == F.col("c")) & F.col("part").eqNullSafe(F.col("p"))
    placed = (
        rows.withColumn("n", F.row_number().over(own)).join(sizes, same).drop("c", "p")
        .withColumn("place", (F.col("start") + F.col("n")).cast("long"))
        .select("conv", "part", "place", _salted(1).alias("s1"), _salted(2).alias("s2"))
    )
    run = W.partitionBy("conv", "part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    hashes = placed.groupBy("conv", "part").agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2")).select(
        F.col("conv").alias("c"), F.col("part").alias("p"),
        *(F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(f"b{s}") for s in ("s1", "s2")))
    return placed.join(hashes, same).select(
        "conv", "place", *(F.bit_xor(s).over(run).bitwiseXOR(F.col(f"b{s}")).alias(h) for s, h in (("s1", "h1"), ("s2", "h2"))))


def _rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
                     F.col(text_col).cast("string").alias("text"))


def _said(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def collapse(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The maximal conversations, rendered: conv_id, n_turns, copies, rendered.

    A conversation is dropped if another one begins with all its turns and goes on; of equal ones the smallest
    id stays, and `copies` counts them. Each conversation is its length and its last rolling hash; those that are
    also the hash of a prefix of a longer one, of the same length, are taken out by an anti-join. Both sides are grouped
    first, so a first turn that very many conversations share is one row, and a much-copied conversation too.
    The hashes have 128 bits. Only the texts of conversations that stay are gathered.

    Rendering: <|im_start|>role, line end, text, <|im_end|>, line end, for each turn in order. A row is one
    conversation, so as large as that, very long texts included.

    Nulls: a row without a conversation id is a conversation of one turn, so that such rows are no hot group, however many; a null turn
    comes first; a null role renders as "user" and a null text as nothing, but neither equals an empty one. Ties: turns of equal number are ordered by
    role and text; those of one number within a conversation are one task's. Repeated rows are turns each. Other columns are not read. An empty table gives no rows.
    """
    placed = keep(turns(df, conv_col, turn_col, role_col, text_col))
    rows = _rows(df, conv_col, turn_col, role_col, text_col)
    lone = rows.where("conv IS NULL").withColumn("place", F.lit(1).cast("long")).select(
        "conv", "place", _salted(1).alias("h1"), _salted(2).alias("h2"), _said(F.col("role"), F.col("text")).alias("said"))
    ends = placed.groupBy("conv").agg(F.max(F.struct("place", "h1", "h2")).alias("e")).select("conv", "e.*", F.lit(None).cast("string").alias("said"))
    heads = ends.unionByName(lone).groupBy("place", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"), F.min("said").alias("said"))
    last = ends.select(F.col("conv").alias("c"), F.col("place").alias("end"))
    inner = placed.join(last, (F.col("conv") == F.col("c")) & (F.col("place") < F.col("end")), "left_semi")
    prefixes = inner.select("place", "h1", "h2").distinct()
    kept = cut(heads.join(prefixes, ["place", "h1", "h2"], "left_anti").select(F.col("conv").alias("c"), F.col("place").alias("n_turns"), "copies", "said"))
    gathered = (
        rows.join(kept.where("c IS NOT NULL").drop("said"), F.col("conv") == F.col("c"))
        .groupBy("conv", "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
        .select(F.col("conv").alias("conv_id"), "n_turns", "copies", F.array_join(F.transform("all", lambda x: _said(x["role"], x["text"])), "").alias("rendered"))
    )
    alone = kept.where("c IS NULL").select(F.col("c").alias("conv_id"), "n_turns", "copies", F.col("said").alias("rendered"))
    return gathered.unionByName(alone).withColumns({c: F.col(c).cast("long") for c in ("n_turns", "copies")})
