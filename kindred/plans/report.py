"""From a file of word vectors to lines of each word's nearest words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joiners import BlockedLsh
from ..operators.topk import top_k
from ..sources.vectors import read_text


def neighbour_report(pairs: DataFrame, words: DataFrame, k: int = 10) -> DataFrame:
    """(word, line): each word and its k best neighbours, best first, as "word --> a,b,c"."""
    best = top_k(pairs, k)
    a, b = words.select(F.col("id").alias("i"), "word"), words.select(F.col("id").alias("j"), F.col("word").alias("other"))
    named = best.join(a, "i").join(b, "j")
    lines = named.groupBy("i", "word").agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "j", "other"))).alias("all"))
    return lines.select("word", F.concat("word", F.lit(" --> "), F.array_join(F.transform("all", lambda x: x["other"]), ",")).alias("line"))


def main(spark: SparkSession, path: str, joiner: BlockedLsh | None = None, lines: int = 20) -> DataFrame:
    """The example application: prints some lines, and returns all."""
    words = read_text(spark, path)
    report = neighbour_report((joiner or BlockedLsh(0.5, 20, 200, 10)).join(words.select("id", "vector")), words)
    report.show(lines, truncate=False)
    return report
