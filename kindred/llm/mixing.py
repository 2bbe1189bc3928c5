"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, cut, keep

#: A source's ranks are cut into so many buckets, and the one where its quota ends into as many again. Only what
#: is left then, one document of BUCKETS * BUCKETS, is gone through in order.
BUCKETS = 1 << 13
#: Tables of sources up to this many rows are broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 10_000


def words(text: str):
    """The number of runs of anything but ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """Adds each source's target, from its `size`: shares by weight, none above `most` times its size.

    With T words in all, target = min(most * size, level * weight), the level such that the targets add up to T.
    Sources fill up in the order of most * size / weight; where the k-th would not, given that all before it
    have, the level is found. One row per source passes through the one window here.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    filling = W.orderBy("full_at", "number")
    s = sources.withColumn("number", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("full_at", most * F.col("size") / F.col("weight")).withColumn(
        "level",
        (F.sum("size").over(W.partitionBy()) - F.coalesce(F.sum(most * F.col("size")).over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing)),
    )
    level = F.min_by(F.when(F.col("full_at") >= F.col("level"), F.col("level")),
                     F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "number"))).over(W.partitionBy())
    return s.withColumn("target", F.when(F.col("full_at") < F.col("level"), most * F.col("size")).otherwise(
        F.least(most * F.col("size"), level * F.col("weight")))).drop("level", "full_at")


def inclusion(classes: DataFrame, lean: float) -> DataFrame:
    """Adds p, the inclusion probability of a source's documents of one length class, to source, class, words and quota.

    p = min(1, level * 2 ** (lean * class)), the level such that the words expected add up to the quota. Going from the
    longest class down, those that would exceed 1 are certain and set apart, and the first that does not gives the
    level of the rest. A source has a class for each power of two, so a few dozen rows.
    """
    own = W.partitionBy("source")
    down = own.orderBy(F.desc("class"))
    c = classes.withColumn("g", F.pow(F.lit(2.0), F.lit(lean) * F.col("class")))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("g") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing))
    c = c.withColumn("level", F.try_divide(F.col("quota") - before, rest))  # null where all that is left has no words
    fits = F.when(F.col("level") * F.col("g") <= 1, F.col("class"))
    level = F.max_by("level", fits).over(own)  # nulls are passed over
    return c.withColumn("p", F.when(F.col("quota") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(level, F.lit(1.0)) * F.col("g")))).select("source", "class", "p")


def _first(sums: DataFrame, by: str) -> DataFrame:
    """Of each source the bucket where its words reach `need`, and what is needed of it: source, end, rest."""
    upto = F.sum("sum").over(W.partitionBy("source").orderBy(by))
    return (
        sums.withColumn("upto", upto).where("upto >= need").groupBy("source")
        .agg(F.min(F.struct(by, (F.col("need") - (F.col("upto") - F.col("sum"))).alias("rest"))).alias("e"))
        .select(F.col("source").alias("of_source"), F.col(f"e.{by}").alias("end"), F.col("e.rest").alias("rest"))
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


class Mix:
    """The plan of a mix: what each source gets, and which documents are sampled.

    Pareto order sampling. A source whose target is r times its size takes floor(r) whole copies of every document for
    certain; what is left to its target, the quota in words, is sampled. Each document has an inclusion probability p of
    its own, by source and length: p rises as the length to the power `lean`, by powers of two, and the words expected are the
    quota; where p would exceed 1, the document is certain (see inclusion). lean = 0 gives all documents of a source one p.
    A document's rank is its random odds over its inclusion odds, (u / (1 - u)) / (p / (1 - p)), u uniform and drawn from the md5 of the
    seed, the id and the text. The lowest ranks are taken as long as they fit in the quota: the sample's size is fixed in
    words. Then one more document of those left may be taken, the one that brings the source nearest to its target; so at most
    one of a source's documents is not there by its rank.

    A hot source is never one task's: its ranks are cut into buckets, the buckets are added up where they lie, and that where
    the quota ends is cut again, so that one document of 2**26 is left to go through in order. What is broadcast has a row
    per source, or per source and length class, and is joined by a shuffle if it is large. Ranks depend on the rows alone,
    so reruns agree.

    Nulls: a null source is a source, last in order; null texts have no words and are taken 0 times; null ids
    are ids. Equal rows are ranked alike and each keeps its own copies. A very long text is one number here: it is sampled like
    others, and if its source's quota is smaller than it, its rank ends the sample. Other columns are not read. An empty
    table gives no rows, and so does one whose texts have no words take none.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, lean: float = 0.2):
        self.columns = (id_col, text_col, source_col)
        self.most, self.seed = most, seed
        rows = self._ranked(docs).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), "size", "class", "key", "u")
        self.rows = keep(rows)
        classes = cut(self.rows.groupBy("source", "class").agg(F.sum("size").alias("words")))
        sources = classes.groupBy("source").agg(F.sum("words").cast("double").alias("size"))
        ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
        s = targets(sources, weights, most).withColumn("copies", F.floor(ratio + 1e-9)).select(
            F.col("source").alias("of_source"), F.col("size").cast("long").alias("source_size"), "target", F.col("copies").cast("long").alias("copies"),
            F.greatest(F.round("target").cast("long") - (F.col("copies") * F.col("size")).cast("long"), F.lit(0)).alias("quota"),
        )
        self.sources = cut(s)
        told = self.sources.select("of_source", "quota")
        odds = inclusion(classes.join(told, _same("source", "of_source")).drop("of_source"), lean)
        self.inclusion = cut(odds.withColumnsRenamed({"source": "p_source", "class": "p_class"}))
        self.plan = cut(self._planned())

    def _planned(self) -> DataFrame:
        """Where each source's sample ends: at rank end_t and key end_key, of whose rows `part` are in; and the odd document's key."""
        at = self._joined(self._at(self.rows), self.sources).where("quota > 0 AND size > 0")
        b1 = F.least(F.floor(F.col("t") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        at = at.withColumn("b1", b1).withColumn("b2", F.least(F.floor((F.col("t") * BUCKETS - F.col("b1")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        at = at.select("source", "size", "key", "t", "b1", "b2", "quota")
        one = cut(_first(at.groupBy("source", "b1", F.col("quota").alias("need")).agg(F.sum("size").alias("sum")), "b1").withColumnsRenamed({"end": "e1", "rest": "r1"}))
        in1 = self._joined(at, one).where("b1 = e1").drop("e1")
        two = cut(_first(in1.groupBy("source", "b2", F.col("r1").alias("need")).agg(F.sum("size").alias("sum")), "b2").withColumnsRenamed({"end": "e2", "rest": "r2"}))
        in2 = self._joined(in1, two).where("b2 = e2")
        each = in2.groupBy("source", "t", "key", "size", "r2").count()
        each = each.withColumn("sum", F.col("size") * F.col("count")).withColumn("upto", F.sum("sum").over(W.partitionBy("source").orderBy("t", "key", "size")))
        left = F.col("r2") - (F.col("upto") - F.col("sum"))
        part = F.least(F.col("count"), F.floor(left / F.col("size"))).cast("long")
        ends = each.where("upto >= r2").groupBy("source").agg(
            F.min(F.struct(F.col("t").alias("end_t"), F.col("key").alias("end_key"), "size", part.alias("part"), "count", (left - part * F.col("size")).alias("gap"))).alias("e"))
        ends = cut(ends.select(F.col("source").alias("of_source"), "e.end_t", "e.end_key", "e.part", "e.count", "e.gap"))
        after = (F.col("t") > F.col("end_t")) | ((F.col("t") == F.col("end_t")) & ((F.col("key") > F.col("end_key")) | ((F.col("key") == F.col("end_key")) & (F.col("part") < F.col("count")))))
        off = F.abs(F.col("size") - F.col("gap"))
        odd = self._joined(at, ends).where(after & (off < F.col("gap"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "t", "key")).alias("m"))
        odd = odd.select(F.col("source").alias("odd_source"), F.col("m.key").alias("odd_key"))
        plan = self.sources.join(ends.withColumnRenamed("of_source", "end_source"), _same("of_source", "end_source"), "left")
        plan = plan.join(odd, _same("of_source", "odd_source"), "left")
        return plan.select("of_source", "source_size", "target", "copies", "quota", "end_t", "end_key", "part", "odd_key")

    def _ranked(self, docs: DataFrame) -> DataFrame:
        id_col, text_col, _ = self.columns
        told = F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.concat(F.lit("t"), F.col(text_col).cast("string")), F.lit("-")))
        digits = lambda lo, n: F.conv(F.substring(F.md5(told), lo, n), 16, 10).cast("long")
        key, u = digits(1, 15), (digits(16, 13).cast("double") + 0.5) / F.lit(float(1 << 52))
        size = F.col("size")
        return docs.withColumns({"size": words(text_col), "key": key, "u": u}).withColumn("class", F.when(size > 0, F.length(F.bin(size)) - 1).otherwise(0))

    def _at(self, rows: DataFrame) -> DataFrame:
        """Adds p and t, the rank x as x / (1 + x), so between 0 and 1."""
        odds = F.broadcast(self.inclusion) if self.inclusion.count() <= 32 * MOST_BROADCAST else self.inclusion
        rows = rows.join(odds, _same("source", "p_source") & (F.col("class") == F.col("p_class"))).drop("p_source", "p_class")
        low, high = F.col("u") * (1 - F.col("p")), F.col("p") * (1 - F.col("u"))
        return rows.withColumn("t", low / (low + high))

    def _joined(self, rows: DataFrame, sources: DataFrame) -> DataFrame:
        other = F.broadcast(sources) if sources.count() <= MOST_BROADCAST else sources
        return rows.join(other, _same("source", "of_source")).drop("of_source")

    def _counted(self, rows: DataFrame) -> DataFrame:
        """Rows, of columns that _ranked gives and a source, with `times`: how often the mix takes each.

        Only rows of a key where a sample ends, and the odd ones, meet a shuffle: of equal rows some may be in.
        """
        at = self._joined(self._at(rows), self.plan)
        sampled = F.col("quota") > 0
        open_ = sampled & (F.coalesce(F.col("key") == F.col("end_key"), F.lit(False)) | F.coalesce(F.col("key") == F.col("odd_key"), F.lit(False)))
        before = (F.col("t") < F.col("end_t")) | ((F.col("t") == F.col("end_t")) & (F.col("key") < F.col("end_key")))
        sure = at.where(~open_).withColumn("times", F.col("copies") + F.coalesce(sampled & before, F.lit(False)).cast("long"))
        nth = F.row_number().over(W.partitionBy("source", "key").orderBy("t"))
        some = F.when(F.col("key") == F.col("end_key"), F.col("part")).otherwise(0) + F.when(F.col("key") == F.col("odd_key"), 1).otherwise(0)
        rest = at.where(open_).withColumn("times", F.col("copies") + (nth <= some).cast("long"))
        return sure.unionByName(rest)

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and taken, the words that the mix takes of each row."""
        return self._counted(self.rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))

    def documents(self, docs: DataFrame) -> DataFrame:
        """The rows of docs, each as many times as the mix takes it; rows without words are not taken."""
        id_col, text_col, source_col = self.columns
        cols = [f"__c{i}" for i in range(len(docs.columns))]
        rows = docs.select([F.col(c).alias(n) for c, n in zip(docs.columns, cols, strict=True)])
        rows = self._ranked(rows.withColumns({n: F.col(cols[docs.columns.index(n)]) for n in (id_col, text_col)}))
        rows = rows.withColumn("source", F.col(cols[docs.columns.index(source_col)])).select(*cols, "source", "size", "class", "key", "u")
        out = self._counted(rows).where("times > 0 AND size > 0")
        out = out.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        return out.select([F.col(n).alias(c) for c, n in zip(docs.columns, cols, strict=True)])
