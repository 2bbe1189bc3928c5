"""Similarity joins: exact, by sorted signatures, by hash buckets, and by Hamming distance.

Inputs are vector tables (id, vector), results pairs (i, j, value). A similarity of NaN passes no threshold. Every
random choice takes a seed, so that results are the same whenever they are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hyperplanes
from ..functions.vectors import COSINE, Similarity, _cosine_tile
from ..sources.vectors import check
from . import buckets, tiles
from .signatures import keyed_rounds, matrix
from .store import hold, small
from .topk import distinct_pairs, distinct_top_k, first_per_key, top_k
from .windows import signature_part, with_block, with_position

PAIRS = "i long, j long, value double"


class SelfJoiner(Protocol):
    def join(self, vectors: DataFrame) -> DataFrame: ...


class QueryJoiner(Protocol):
    def join(self, query: DataFrame, catalog: DataFrame) -> DataFrame: ...


def _features(df: DataFrame) -> int:
    row = df.select(F.size("vector")).first()
    return row[0] if row else 1


def _passing(value, threshold: float):
    # Spark orders NaN above all numbers.
    return (value >= threshold) & ~F.isnan(value)


def _drawn(fraction: float, seed: int):
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    return draw < fraction * 2.0**32


def sampled(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """A Bernoulli sample without replacement: rows whose md5 of seed and id falls below the fraction, so the same whenever it is drawn."""
    return df if fraction >= 1 else df.where(_drawn(fraction, seed))


def _exact(left: DataFrame, right: DataFrame, similarity: Similarity, threshold: float, order: str | None) -> DataFrame:
    """Pairs of a left row i and a right row j; `order` "<" or "<>" is asked of i and j."""
    if similarity.tile is None:
        a, b = (x.select(F.col("id").alias(i), F.col("vector").alias(f"v{i}")) for x, i in ((left, "i"), (right, "j")))
        # Expressions over arrays take microseconds a pair, so the pairs are for all cores, however few files the rows were read from.
        a = a.repartition(4 * a.sparkSession.sparkContext.defaultParallelism)
        pairs = a.join(b, F.expr(f"i {order} j")) if order else a.crossJoin(b)
        return pairs.select("i", "j", similarity.column(F.col("vi"), F.col("vj")).alias("value")).where(_passing(F.col("value"), threshold))

    def kernel(ids_a, a, ids_b, b):
        s = similarity.tile(a, b)
        with np.errstate(invalid="ignore"):
            keep = s >= threshold
        if order == "<":
            keep &= ids_a[:, None] < ids_b[None, :]
        elif order:
            keep &= ids_a[:, None] != ids_b[None, :]
        x, y = np.nonzero(keep)
        return ids_a[x], ids_b[y], s[x, y]

    return tiles.score(tiles.tiles(left), tiles.tiles(right), kernel, PAIRS)


class _Best:
    """A tile's best `k` pairs per row of its own, by value and then by the smaller other id, of all the other tiles that it meets."""

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray):
        self.ids, self.k, self.least = ids, k, least
        self.row, self.other, self.value = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, least.dtype)

    def add(self, row: np.ndarray, other: np.ndarray, value: np.ndarray) -> None:
        """Takes more pairs. `least` then has each row's k-th value, below which no pair is among its best."""
        if not len(row):
            return
        row, other, value = (np.concatenate(x) for x in ((self.row, row), (self.other, other), (self.value, value)))
        order = np.lexsort((other, -value, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == self.k - 1
        self.least[row[last]] = value[order[last]]
        order, self.row = order[rank < self.k], row[rank < self.k]
        self.other, self.value = other[order], value[order]


class _BestBySimilarity(_Best):
    def __init__(self, similarity: Similarity, threshold: float, k: int, order: str | None, ids: np.ndarray, x: np.ndarray):
        super().__init__(ids, k, np.full(len(ids), threshold, np.float64))
        self.similarity, self.threshold, self.order, self.x = similarity, threshold, order, x

    def step(self, ids: np.ndarray, y: np.ndarray) -> None:
        rows = self.similarity.rows
        s = self.similarity.tile(self.x, y)
        # A product may be some ulps below the value by rows, which decides.
        least = self.least if rows is None else self.least - 1e-9 * (1 + np.abs(self.least))
        with np.errstate(invalid="ignore"):
            keep = s >= least[:, None]
        if self.order == "<":
            keep &= self.ids[:, None] < ids[None, :]
        elif self.order:
            keep &= self.ids[:, None] != ids[None, :]
        at = np.flatnonzero(keep)
        if len(at) > 4 * self.k * len(s) and self.k < s.shape[1]:
            # Of many that pass, as at first, those below the tile's own k-th best need not be compared.
            kth = np.partition(np.where(keep, s, -np.inf), -self.k, axis=1)[:, -self.k]
            at = np.flatnonzero(keep & (s >= (kth if rows is None else kth - 1e-9 * (1 + np.abs(kth)))[:, None]))
        a, b = np.divmod(at, s.shape[1])
        for k in range(0, len(a), 1 << 16):
            i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            value = s[i, j] if rows is None else rows(self.x[i], y[j])
            with np.errstate(invalid="ignore"):
                fit = value >= self.threshold
            self.add(i[fit], ids[j[fit]], value[fit])

    def result(self) -> tuple:
        return self.ids[self.row], self.other, self.value


def _exact_best(left: DataFrame, right: DataFrame, similarity: Similarity, threshold: float, order: str | None, k: int) -> DataFrame:
    """Of the pairs of _exact the best k per left row."""
    if similarity.tile is None:
        return top_k(_exact(left, right, similarity, threshold, order), k)
    if k < 1:
        raise ValueError("k must be positive")
    return top_k(tiles.folded(tiles.tiles(left), tiles.tiles(right), lambda ids, x: _BestBySimilarity(similarity, threshold, k, order, ids, x), PAIRS), k)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair also as (j, i): a self-join gives i < j only, which hides a row's partners of smaller ids."""
    e = F.explode(F.array(F.struct("i", "j", "value"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value")))
    return pairs.select(e.alias("e")).select("e.*")


@dataclass(frozen=True)
class ExactSelfJoin:
    """All pairs i < j of similarity `threshold` or more. With `fraction` under 1 only a sample of rows looks for
    partners of larger ids among all rows. The cosine of equal vectors can be an ulp under 1: for a threshold of
    1 give 1 - 1e-12 or so. `symmetric` gives each pair both ways, and of a sample also those whose sampled row has the larger
    id. With `best` only so many pairs per i are returned, those of the largest values, ties to the smaller j; the others leave no task.
    `validate` fails on unequal widths and repeated ids before anything is joined."""

    threshold: float
    similarity: Similarity = COSINE
    fraction: float = 1.0
    seed: int = 0
    symmetric: bool = False
    validate: bool = False
    best: int | None = None

    def join(self, vectors: DataFrame, sample: DataFrame | None = None) -> DataFrame:
        """`sample`, if given, are the rows of `vectors` to take as the sample."""
        if self.symmetric and self.best is not None:
            raise ValueError("the best of each row are not symmetric")
        vectors = check(vectors) if self.validate else vectors
        left = sampled(vectors, self.fraction, self.seed) if sample is None else sample
        if self.best is not None:
            return _exact_best(left, vectors, self.similarity, self.threshold, "<", self.best)
        if not self.symmetric:
            return _exact(left, vectors, self.similarity, self.threshold, "<")
        if sample is None and self.fraction >= 1:
            return both_ways(_exact(left, vectors, self.similarity, self.threshold, "<"))
        # Pairs within the sample, and of the sample with the rest: each pair once, so that none need be told from its like.
        rest = vectors.where(~_drawn(self.fraction, self.seed)) if sample is None else vectors.join(sample.select("id"), "id", "left_anti")
        inner = _exact(left, left, self.similarity, self.threshold, "<")
        return both_ways(inner.unionByName(_exact(left, rest, self.similarity, self.threshold, None)))


@dataclass(frozen=True)
class ExactQueryJoin:
    """All pairs of a query and a catalog row of similarity `threshold` or more; both sides can be sampled. With `best` only so many
    pairs per query row, those of the largest values, ties to the smaller j; the others leave no task."""

    threshold: float
    similarity: Similarity = COSINE
    query_fraction: float = 1.0
    catalog_fraction: float = 1.0
    seed: int = 0
    best: int | None = None

    def join(self, query: DataFrame, catalog: DataFrame) -> DataFrame:
        query = sampled(query, self.query_fraction, self.seed)
        catalog = sampled(catalog, self.catalog_fraction, self.seed + 1)
        if self.best is not None:
            return _exact_best(query, catalog, self.similarity, self.threshold, None, self.best)
        return _exact(query, catalog, self.similarity, self.threshold, None)


@dataclass(frozen=True)
class BlockedLsh:
    """Approximate self-join: neighbours in the order of their signatures are compared.

    The bits of one signature are put into another order `permutations` times; each time the signatures are
    sorted and cut into blocks of `block_size`, and the pairs of each block are scored by cosine. All
    permutations are one plan. What is sorted are ids and signatures; the vectors are joined to their blocks'
    numbers once, by id, and then go to the blocks. Blocks are bounded, so a task holds few rows. Ids are unique: `validate` checks that, and the
    widths. `partitions` deals the signatures anew before they are sorted, which adaptive execution rarely leaves to do.
    """

    min_similarity: float
    dimensions: int
    block_size: int
    permutations: int
    seed: int = 42
    symmetric: bool = False
    validate: bool = False
    partitions: int | None = None

    def rounds(self, features: int) -> list[np.ndarray]:
        r = hyperplanes.planes(features, self.dimensions, self.seed)
        return [hyperplanes.permuted(r, hyperplanes.permutation(self.dimensions, self.seed + 1 + k)) for k in range(self.permutations)]

    def blocks(self, vectors: DataFrame, features: int | None = None) -> DataFrame:
        if self.permutations < 1:
            raise ValueError("at least one permutation is needed")
        vectors = check(vectors, features) if self.validate else vectors
        keyed = keyed_rounds(vectors, self.rounds(features or _features(vectors)), vectors=False)
        keyed = hold(keyed if self.partitions is None else keyed.repartition(self.partitions))
        placed = with_position(keyed, ["sig_key", "id"], signature_part(), ["round"])
        return with_block(placed, self.block_size)

    def join(self, vectors: DataFrame, features: int | None = None) -> DataFrame:
        low = self.min_similarity

        def pairs(table: pa.Table) -> pa.Table:
            ids = table.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x = matrix(table.column("vector").combine_chunks(), len(table.column("vector")[0]))[order]
            ids, s = ids[order], _cosine_tile(x, x)
            with np.errstate(invalid="ignore"):
                a, b = np.nonzero((s >= low) & (ids[:, None] < ids[None, :]))
            return pa.table({"i": ids[a], "j": ids[b], "value": s[a, b]})

        where = self.blocks(vectors, features).groupBy("id").agg(F.collect_list(F.struct("round", "block")).alias("where"))
        rows = vectors.select("id", "vector").join(where, "id").select("id", "vector", F.explode("where").alias("at")).select("at.*", "id", "vector")
        found = rows.groupBy("round", "block").applyInArrow(pairs, PAIRS)
        found = distinct_pairs(found)
        return both_ways(found) if self.symmetric else found


def _scored(pairs: DataFrame, low: float) -> DataFrame:
    """(i, j, cosine) of rows i, vi, j, vj, from `low` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, vi, j, vj = batch.columns
            if not len(i):
                continue
            a, b = matrix(vi, len(vi[0])), matrix(vj, len(vi[0]))
            na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
            zero = (na == 0) | (nb == 0)
            with np.errstate(invalid="ignore"):
                s = np.where(zero, 0.0, np.einsum("ij,ij->i", a, b) / np.where(zero, 1, na) / np.where(zero, 1, nb))
                keep = s >= low
            yield pa.RecordBatch.from_arrays([i.filter(pa.array(keep)), j.filter(pa.array(keep)), pa.array(s[keep])], names=["i", "j", "value"])

    return pairs.select("i", "vi", "j", "vj").mapInArrow(run, PAIRS)


@dataclass(frozen=True)
class BucketLsh:
    """Approximate query join: queries meet catalog rows of the same signature, in several rounds of fresh planes.

    In each round a bucket gives at most `max_candidates` catalog rows, those of the smallest ids, before anything is
    scored. With `flips` each catalog row is also put into the buckets of so many signatures that differ in one
    bit. Queries of buckets above the `salt_percentile` of bucket sizes are spread over salted copies of the bucket;
    the result is the same, as all copies hold the same rows. The best `max_matches` per query are returned.
    """

    min_similarity: float
    dimensions: int
    max_candidates: int
    max_matches: int
    rounds: int
    flips: int = 0
    salt_percentile: float | None = 0.95
    seed: int = 100

    def planes(self, features: int) -> list[np.ndarray]:
        if self.rounds < 1:
            raise ValueError("at least one round is needed")
        return [hyperplanes.planes(features, self.dimensions, self.seed + k) for k in range(self.rounds)]

    def join(self, query: DataFrame, catalog: DataFrame, features: int | None = None) -> DataFrame:
        rounds = self.planes(features or _features(query))
        q, c = keyed_rounds(query, rounds), keyed_rounds(catalog, rounds)
        c = buckets.with_flips(c, self.flips, self.dimensions)
        c = first_per_key(c, ["round", "sig_key"], ["id", "flip"], self.max_candidates)
        keys = ["round", "sig_key"]
        if self.salt_percentile is not None:
            q = hold(q)
            splits = small(buckets.splits(buckets.sizes(q, keys), self.salt_percentile))
            q, c, keys = buckets.salted(q, splits, self.seed), buckets.replicated(c, splits), [*keys, "salt"]
        q = q.select(*keys, F.col("id").alias("i"), F.col("vector").alias("vi"))
        c = c.select(*keys, F.col("id").alias("j"), F.col("vector").alias("vj"))
        return distinct_top_k(_scored(q.join(c, keys), self.min_similarity), self.max_matches)


def _signs(packed: np.ndarray, d: int) -> np.ndarray:
    return np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1


class _BestByDistance(_Best):
    """Values are the signs' products, whole numbers: d less twice the distance."""

    def __init__(self, d: int, low: float, k: int, by_query: bool, ids: np.ndarray, x: np.ndarray):
        self.cosines = np.cos(np.pi * np.arange(d + 1) / d)
        within = int(np.count_nonzero(self.cosines >= low)) - 1  # the largest distance that passes
        super().__init__(ids, k, np.full(len(ids), d - 2 * within, np.float32))
        self.d, self.by_query, self.signs = d, by_query, _signs(x, d)

    def step(self, ids: np.ndarray, y: np.ndarray) -> None:
        products = self.signs @ _signs(y, self.d).T
        a, b = np.divmod(np.flatnonzero(products >= self.least[:, None]), len(ids))
        self.add(a, ids[b], products[a, b])

    def result(self) -> tuple:
        own, value = self.ids[self.row], self.cosines[((self.d - self.value) / 2).round().astype(np.int64)]
        return (own, self.other, value) if self.by_query else (self.other, own, value)


class _Distances:
    """How many rows are at each distance of a tile's own ones."""

    def __init__(self, d: int, ids: np.ndarray, x: np.ndarray):
        self.d, self.ids, self.signs = d, ids, _signs(x, d)
        self.first = np.arange(len(ids), dtype=np.int64)[:, None] * (d + 1)
        self.all, self.same = (np.zeros((len(ids), d + 1), np.int64) for _ in range(2))

    def step(self, ids: np.ndarray, y: np.ndarray) -> None:
        other = _signs(y, self.d)
        shared = np.isin(ids, self.ids)
        # By some rows at a time: what is counted then stays in the processor's cache.
        for k in range(0, len(self.ids), 64):
            own = slice(k, k + 64)
            apart = ((self.d - self.signs[own] @ other.T) / 2).astype(np.int64)
            at = apart + self.first[own] - self.first[k]
            self.all[own] += np.bincount(at.ravel(), minlength=len(at) * (self.d + 1)).reshape(len(at), -1)
            if shared.any():
                a, b = np.nonzero(self.ids[own, None] == ids[None, :])
                np.add.at(self.same[own], (a, apart[a, b]), 1)

    def result(self) -> tuple:
        others = self.all > self.same
        nearest = pa.array(others.argmax(axis=1), pa.int64(), mask=~others.any(axis=1))
        return self.ids, self.all @ np.arange(self.d + 1), nearest, self.all[:, 0], self.all @ np.cos(np.pi * np.arange(self.d + 1) / self.d)


@dataclass(frozen=True)
class HammingJoin:
    """Query join by the cosine that the Hamming distance of two signatures of `dimensions` bits stands for.

    `result_size` pairs stay per row of `limit_per`, "query" or "catalog". `broadcast` names the side that is sent to
    all tasks if it is small enough and not the one of `limit_per`, whose tiles gather their best from all of the other's. A pair of tiles is
    one product of signs.
    """

    min_similarity: float
    dimensions: int
    result_size: int
    broadcast: str = "catalog"
    limit_per: str = "query"
    seed: int = 7

    def join(self, query: DataFrame, catalog: DataFrame, features: int | None = None) -> DataFrame:
        if {self.broadcast, self.limit_per} - {"query", "catalog"}:
            raise ValueError("broadcast and limit_per are query or catalog")
        d, low, k, by_query = self.dimensions, self.min_similarity, self.result_size, self.limit_per == "query"
        r = hyperplanes.planes(features or _features(query), d, self.seed)

        def start(ids: np.ndarray, x: np.ndarray) -> _BestByDistance:
            return _BestByDistance(d, low, k, by_query, ids, x)

        query, catalog = tiles.bit_tiles(query, r), tiles.bit_tiles(catalog, r)
        own, other = (query, catalog) if by_query else (catalog, query)
        return top_k(tiles.folded(own, other, start, PAIRS, self.broadcast != self.limit_per, np.uint8), k, "i" if by_query else "j")


def hamming_sums(query: DataFrame, catalog: DataFrame, r: np.ndarray) -> DataFrame:
    """Per query row over all catalog rows, by signatures of the planes r: i; distances, the sum of the Hamming distances; nearest, the least
    one from a row of another id; equal, how many are 0; cosines, the sum of the cosines that they stand for."""
    found = tiles.folded(tiles.bit_tiles(query, r), tiles.bit_tiles(catalog, r), lambda ids, x: _Distances(r.shape[1], ids, x),
                         "i long, distances long, nearest long, equal long, cosines double", dtype=np.uint8)
    return found.groupBy("i").agg(F.sum("distances").alias("distances"), F.min("nearest").alias("nearest"), F.sum("equal").alias("equal"), F.sum("cosines").alias("cosines"))
