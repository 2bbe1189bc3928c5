"""Near-duplicate documents by bottom-k sketches of one hash function, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected, cut, keep
from .words import shingles

#: Values that a sketch retains.
K = 64
#: A list of at most so many documents is gone through pair by pair; longer ones start from a centre.
SHORT = 32
#: About so many values, the most frequent, are looked for first to be listed last. Others count as rare, whatever their number.
FREQUENT = 1 << 16
#: The bitmap of values that several rows list: so many bits, 2 MB, made in parts of 4 KB.
FILTER, PART = 1 << 24, 1 << 15


def common_needed(kept: int, k: int = K, similarity: float = 0.85) -> int:
    """The values that sketches of `kept` values share at least, if the sets' similarity reaches the bound.

    Of the k least values of the union, each is shared with the bound's probability. Five and a half standard
    deviations and one less than the mean: for k = 64 and 0.85 that is 37, missed by one pair in 10^7 right at the bound and
    by fewer above it. A set of fewer than k values is its own sketch, and 0.85 of it are shared for certain.
    """
    low = int(k * similarity - 5.5 * (k * similarity * (1 - similarity)) ** 0.5) - 1
    return max(1, ceil(low * kept / k))


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed ones of the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _sketch(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for i in range(0, len(ids), 500):
                rows = []
                for t in texts[i : i + 500].to_pylist():
                    s = shingles(t, width)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, _signed(s[:k])))
                n, digest, least = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids[i : i + 500], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(least, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "digest", "sketch"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for i in range(0, len(ids), 200):
                sets = [_signed(shingles(t, width)) for t in texts[i : i + 200].to_pylist()]
                yield pa.RecordBatch.from_arrays([ids[i : i + 200], pa.array(sets, pa.list_(pa.int64()))], names=["v", "items"])

    return run


def frequent(df: DataFrame, values: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the values that occur in `least` rows or more the most frequent ones, about FREQUENT, sorted, and their counts. Only an order hangs on them.

    How many values have each count tells from which count on all are taken; of the next count a share is, by a hash. So tasks send the
    driver what is taken only: a limit would get as many from each of them, which is too much where most documents have near copies.
    Different counts are few: m of them take m * m / 2 entries of `values`.
    """
    often = cut(df.select(F.explode(values).alias("x")).groupBy("x").count().where(F.col("count") >= least))
    taken, room = F.lit(True), FREQUENT
    for r in sorted(often.groupBy("count").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["count"]):
        if r.n > room:
            share = F.pmod(F.xxhash64("x"), F.lit(r.n)) < room
            taken = (F.col("count") > r["count"]) | ((F.col("count") == r["count"]) & share)
            break
        room -= r.n
    top = sorted(often.where(taken).collect(), key=lambda r: r.x)
    return np.array([r.x for r in top], np.int64), np.array([r["count"] for r in top], np.int64)


LISTED = "x long, v long, n long, pos long"


def met(lists: DataFrame) -> np.ndarray:
    """A bitmap of hashes of the values in `lists`; of fixed size, so that it can go to all tasks."""
    slot = F.pmod("x", F.lit(FILTER))
    parts = lists.select((slot / PART).cast("int").alias("part"), (slot % PART).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros((FILTER // PART, PART // 8), np.uint8)
    for r in parts.collect():
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    return bits.ravel()


def _listed(spark: SparkSession, order: tuple[np.ndarray, np.ndarray], prefix, only: np.ndarray | None = None) -> callable:
    """The first values of each row in the order rare to frequent: (x, v, n, pos), pos counting from 0.

    Two sets that share c values of m share one of the first m - c + 1, in any order that is the same for all.
    With `only`, values that are not in the bitmap are left out: no other row lists them.
    """
    held = spark.sparkContext.broadcast((*order, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, bits = held.value
        for batch in batches:
            vs, ns, lists = batch.columns
            for i in range(0, len(vs), 1000):
                out = []
                for items in lists[i : i + 1000]:
                    x = np.asarray(items.values, np.int64)
                    often = np.zeros(len(x), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        often = np.where(known[at] == x, counts[at], 0)
                    out.append(x[np.lexsort((x, often))][: prefix(len(x))])
                size = np.array([len(x) for x in out])
                row = np.repeat(np.arange(len(out)), size)
                pos, x = np.concatenate([np.arange(s) for s in size]), np.concatenate(out)
                if bits is not None:
                    slot = x % FILTER
                    has = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    row, pos, x = row[has], pos[has], x[has]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x), vs[i : i + 1000].take(pa.array(row)), ns[i : i + 1000].take(pa.array(row)), pa.array(pos, pa.int64())],
                    names=["x", "v", "n", "pos"])

    return run


def _pairs(entries: DataFrame, reach: str) -> DataFrame:
    """All pairs of each list, of sizes that the bound allows; for lists of at most SHORT rows."""
    a, b = entries.alias("a"), entries.alias("b")
    return a.join(b, (F.col("a.x") == F.col("b.x")) & F.expr(f"a.v < b.v AND {reach}")).select(F.col("a.v").alias("u"), F.col("b.v").alias("v"))


class NearDuplicates:
    """Links and groups of near-equal documents.

    1. One pass hashes the shingles of every text and keeps its size, a digest of the set and the K least
       values, the sketch. Texts of equal sets are a class, from here on represented by its smallest id.
    2. Inverted lists of retained values. A sketch is listed under so many of its values that two that share
       common_needed() meet, the rarest first, so that what many documents share is listed only where little
       else is there. Lists of at most SHORT documents give all their pairs; the overlap of the two sketches
       within the union's K least values estimates the similarity, and pairs clearly below are left.
    3. Longer lists are groups of copies, or documents that consist of frequent passages. Their documents are
       listed again, by their full sets: a pair that reaches the bound shares one of the first 15 %, rarest
       first. An entry knows how many values it has from here on, and so the sizes it can reach; entries that
       reach none of their list go. Each list that is left links all documents to the one with the fewest
       values before this one, the likely origin of the copies. Then only pairs of different components are
       left: in each list those of all entries with the entries outside the list's largest component.
    4. Every pair is confirmed by intersecting the full sets: links come from nothing else.

    So a group of g copies costs g pairs, not g * g, and no link between different components is lost.
    Documents: integer ids, unique over different texts (different texts of one id count as one document
    that has all their links). Nulls: a null text has no shingles; rows without any, and null ids, link with
    nothing. Repeated rows are one class. Ties: of equal values the smaller goes first in a list, of equal sets the smaller id
    represents. A very long text is one row in memory, with its set of shingles. Other columns are not read. An empty table gives no rows.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85):
        self.percent, self.width = percent, width
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.rows = keep(self.docs.mapInArrow(_sketch(width, K), "doc_id long, n long, digest binary, sketch array<long>"))
        self.classes = cut(
            self.rows.where("doc_id IS NOT NULL AND n > 0").groupBy("digest")
            .agg(F.min(F.struct("doc_id", "n", "sketch")).alias("r"))
            .select("digest", F.col("r.doc_id").alias("v"), F.col("r.n").alias("n"), F.col("r.sketch").alias("sketch")))
        self.links = self._links()

    def _reach(self) -> str:
        """The condition on entries a and b of a list, by the full sets' sizes and positions."""
        t = self.percent
        need = f"{t} * (a.n + b.n) <= {100 + t} *"
        return f"{need} (a.n - a.pos) AND {need} (b.n - b.pos)"

    def _links(self) -> DataFrame:
        spark, t = self.spark, self.percent / 100
        listed = self.classes.select("v", "n", F.col("sketch").alias("items"))
        order = frequent(listed, "items", 8)
        prefix = lambda m: m - common_needed(m, K, t) + 1
        lists = cut(listed.mapInArrow(_listed(spark, order, prefix), LISTED).groupBy("x").count().where("count > 1"))
        entries = listed.mapInArrow(_listed(spark, order, prefix, met(lists)), LISTED).select("x", "v", "n")
        entries = cut(entries.join(lists, "x").select("x", "v", "n", "count"))
        long = entries.where(f"count > {SHORT}").select("v").distinct()
        sizes = f"100 * a.n >= {self.percent} * b.n AND 100 * b.n >= {self.percent} * a.n"
        pairs = _pairs(entries.where(f"count <= {SHORT}").drop("count"), sizes).distinct()
        pairs = cut(self._alike(pairs))
        wanted = cut(pairs.select(F.explode(F.array("u", "v")).alias("v")).unionByName(long).distinct())
        self.sets = cut(self._full(wanted))
        near = cut(self._confirmed(pairs))
        return near.unionByName(self._hot(long))

    def _alike(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches agree as far as the bound asks for."""
        s = self.classes.select("v", "sketch")
        both = pairs.join(s.withColumnsRenamed({"v": "u", "sketch": "a"}), "u").join(s.withColumnRenamed("sketch", "b"), "v")
        union = F.slice(F.array_sort(F.array_union("a", "b")), 1, K)
        shared = F.size(F.array_intersect(union, F.array_intersect("a", "b")))
        need = (F.size(union) * common_needed(K, K, self.percent / 100) / K).cast("int")
        return both.where(shared >= need).select("u", "v")

    def _full(self, wanted: DataFrame) -> DataFrame:
        """The full sets of some documents, those of equal ids united."""
        small = wanted.count() <= 500_000  # ids of 8 bytes
        docs = self.docs.join(F.broadcast(wanted) if small else wanted, self.docs.doc_id == wanted.v, "left_semi")
        sets = docs.mapInArrow(_sets(self.width), "v long, items array<long>")
        return sets.groupBy("v").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")).where("size(items) > 0")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        both = pairs.join(self.sets.withColumnsRenamed({"v": "u", "items": "a"}), "u").join(self.sets.withColumnRenamed("items", "b"), "v")
        common = F.size(F.array_intersect("a", "b"))
        return both.where(100 * common >= self.percent * (F.size("a") + F.size("b") - common)).select("u", "v")

    def _hot(self, long: DataFrame) -> DataFrame:
        """Links among the documents of long lists, so many that they connect what is connected."""
        spark, t = self.spark, self.percent
        sets = self.sets.join(long, "v", "left_semi").select("v", F.size("items").cast("long").alias("n"), "items")
        order = frequent(sets, "items", 3)
        prefix = lambda m: m - -(-t * m // 100) + 1
        lists = sets.mapInArrow(_listed(spark, order, prefix), LISTED).groupBy("x").count().where("count > 1")
        entries = cut(sets.mapInArrow(_listed(spark, order, prefix, met(lists)), LISTED))
        # The largest size that an entry can reach; where that is below its list's least size, it goes.
        reach = F.floor((F.col("n") - F.col("pos")) * (100 + t) / F.lit(t) - F.col("n"))
        for _ in range(2):
            # Kept before the join, whose long lists can then be split.
            lists = cut(entries.groupBy("x").agg(F.count("*").alias("count"), F.min("n").alias("lo"), F.max(reach).alias("hi")).where("count > 1"))
            entries = cut(entries.join(lists, "x").where((reach >= F.col("lo")) & (F.col("n") <= F.col("hi"))).select("x", "v", "n", "pos"))
        lists = cut(entries.groupBy("x").agg(
            F.count("*").alias("count"), F.min(F.struct((F.col("pos") / F.col("n")).alias("at"), "n", "pos", "v")).alias("c")).where("count > 1"))
        short = cut(entries.join(lists.where(f"count <= {SHORT}").select("x"), "x"))  # a join of its own, so that the long lists it drops can be split
        near = _pairs(short, self._reach())
        rest = cut(entries.join(lists.where(f"count > {SHORT}").select("x", "c"), "x"))
        star = rest.alias("a").where("v <> c.v").select(F.least("v", "c.v").alias("u"), F.greatest("v", "c.v").alias("v"))
        links = cut(self._confirmed(near.unionByName(star).distinct()))
        roots = connected(links, "u", "v")
        rest = cut(rest.drop("c").join(roots.withColumnRenamed("node", "v"), "v", "left").select("x", "v", "n", "pos", F.coalesce("root", "v").alias("root")))
        parts = rest.groupBy("x", "root").count().groupBy("x").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("parts"))
        most = cut(parts.where("parts > 1").select("x", F.col("m.root").alias("most")))
        apart = cut(rest.join(most, "x"))  # so that the join below, whose lists can be hot on both sides, can be split
        a, b = apart.where("root <> most").alias("a"), apart.alias("b")
        pairs = a.join(b, (F.col("a.x") == F.col("b.x")) & F.expr(f"a.root <> b.root AND {self._reach()}"))
        pairs = pairs.select(F.least("a.v", "b.v").alias("u"), F.greatest("a.v", "b.v").alias("v")).distinct()
        return links.unionByName(self._confirmed(pairs))

    def groups(self) -> DataFrame:
        """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links) and kept."""
        roots = connected(self.links, "u", "v").select(F.col("node").alias("v"), "root")
        of = self.classes.select("digest", "v").join(roots, "v", "left").select("digest", F.coalesce("root", "v").alias("root"))
        alone = F.col("doc_id").isNull() | (F.col("n") == 0)
        rows = self.rows.select("doc_id", "n", "digest").join(of, "digest", "left")
        component = F.when(alone, F.col("doc_id")).otherwise(F.col("root"))
        return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))

