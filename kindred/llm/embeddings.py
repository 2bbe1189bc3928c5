"""Near-equal embeddings by counting collisions in sorted one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, erf, exp, lgamma, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, cut, keep
from .words import STEPS, mixed

PROJECTIONS, SEED = 16, 7
#: Cells are so many mean differences wide, of a pair right at the bound. A vector's window holds about TARGET others by chance.
CELL, TARGET = 8, 2
#: Collisions that a pair needs in the cells' windows.
NEEDED = 2
#: Vectors with more than HOT in a part of a window are compared block by block instead of pair by pair.
HOT = 64
#: Vectors in a block at most, and pairs of blocks in a task.
BLOCK, TASK_PAIRS = 1024, 16
#: Half a window's width, in standard deviations of a projected difference right at the bound.
WIDTH = 2.5
#: Tables of up to so many rows of a few numbers are broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 100_000
#: The share of pairs right at the bound that may stay below the count.
MISSED = 1e-7


def directions(dim: int) -> np.ndarray:
    """Random orthonormal directions, as columns."""
    q, _ = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, min(dim, PROJECTIONS))))
    return q


def calibrated(dim: int, cosine: float) -> tuple[float, int]:
    """Half the window's width, and the collisions that a pair needs.

    Unit vectors of the bound's cosine are d = sqrt(2 - 2 cosine) apart, and on a random direction about
    d / sqrt(dim), normally distributed. The count is the largest that all but MISSED of such pairs reach; nearer
    pairs collide more often. In few dimensions the distribution is another: there the window is d itself, which
    no such pair exceeds, and all directions must collide.
    """
    d, m = sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6, min(dim, PROJECTIONS)
    if dim < 32:
        return d, m
    hit, below, count = erf(WIDTH / sqrt(2)), 0.0, 0
    while (below := below + comb(m, count) * hit**count * (1 - hit) ** (m - count)) <= MISSED:
        count += 1
    return WIDTH * d / sqrt(dim), count


@dataclass(frozen=True)
class Lines:
    """Sorted lines of one dimension: `axes` projections deal a table's vectors to cells, one more sorts each cell.

    A random direction's difference of a pair at the bound is d * |u| with the mean `step`; cells are CELL times as wide and lie at
    random, so the pair shares one with a chance of 1 - 1 / CELL at least, on every axis. The window around a query holds it with the
    chance `seen`. `axes` grows with the logarithm of the vectors compared, so that a window holds about TARGET of them by chance, and
    the number of tables is the least with which all but MISSED of the pairs at the bound collide NEEDED times. Nearer pairs collide more often.
    """

    dim: int
    axes: int
    tables: int
    half: float
    width: float

    @staticmethod
    def calibrated(dim: int, cosine: float, n: int) -> Lines:
        d = sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
        step = d * exp(lgamma(dim / 2) - lgamma((dim + 1) / 2)) / sqrt(pi)
        half, seen = (d, 1.0) if dim < 32 else (WIDTH * d / sqrt(dim), erf(WIDTH / sqrt(2)))
        width, spread = CELL * step, 1 / sqrt(dim)
        # Two random vectors differ by about sqrt(2) * spread, so share a cell or a window with about these chances.
        chance = lambda w: min(1.0, w / (sqrt(2) * spread * sqrt(2 * pi)))
        by_chance = max(1.0, n * min(1.0, 2 * chance(half)) / TARGET)
        axes = 1 if chance(width) >= 0.9 else max(1, ceil(log(by_chance) / -log(chance(width))))
        hit, tables = (1 - 1 / CELL) ** axes * seen, NEEDED
        while sum(comb(tables, c) * hit**c * (1 - hit) ** (tables - c) for c in range(NEEDED)) > MISSED:
            tables += 1
        return Lines(dim, axes, tables, half, width)

    def drawn(self) -> tuple[np.ndarray, np.ndarray]:
        """Directions, as columns, and the cells' offsets."""
        rng = np.random.default_rng([SEED, 2, self.dim, self.axes])
        r = rng.standard_normal((self.dim, self.tables * (self.axes + 1)))
        return r / np.sqrt((r * r).sum(0)), rng.random((self.tables, self.axes))

    def placed(self, x: np.ndarray, drawn: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors: each table's cell, and the place on its line, in half windows."""
        r, offsets = drawn
        at = (x @ r).reshape(len(x), self.tables, self.axes + 1)
        cells = np.floor(at[:, :, 1:] / self.width + offsets).astype(np.int64).view(np.uint64)
        key = np.arange(self.tables, dtype=np.uint64)[None, :] * STEPS[63] + np.full(1, self.dim, np.uint64) * STEPS[62]
        for k in range(self.axes):
            key = mixed(key + cells[:, :, k] * STEPS[k % 60])
        return key, at[:, :, 0] / self.half


LINES = "v long, hot boolean, first boolean, key long, x double"


def _lines(lines: dict[int, Lines], kind: np.dtype):
    """A row per vector and table: its cell, of its label and dimension, and its place on the cell's line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = {dim: of.drawn() for dim, of in lines.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = batch.take(pa.array(np.flatnonzero(dims == dim)))
                of = lines[int(dim)]
                for i in range(0, mine.num_rows, 512):
                    some = mine.slice(i, 512)
                    x = unit(np.frombuffer(b"".join(some.column("vec").to_pylist()), kind).reshape(some.num_rows, dim))
                    key, at = of.placed(x, drawn[int(dim)])
                    key = mixed(key + some.column("label").to_numpy().view(np.uint64)[:, None] * STEPS[61])
                    each = lambda c: np.repeat(c, of.tables)  # noqa: B023, E731
                    first = np.tile(np.arange(of.tables) == 0, some.num_rows)
                    cols = [each(some.column("v").to_numpy()), each(some.column("hot").to_numpy(zero_copy_only=False)), first, key.ravel().view(np.int64), at.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in LINES.split(", ")])

    return run


def _verified(cosine: float, kind: np.dtype):
    """Candidate pairs that are links: for each of both its partner's copies, and the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = batch.take(pa.array(np.flatnonzero(dims == dim)))
                a, b = (unit(np.frombuffer(b"".join(mine.column(c).to_pylist()), kind).reshape(mine.num_rows, dim)) for c in ("vec_a", "vec_b"))
                near = np.einsum("ij,ij->i", a, b) >= cosine
                va, vb, ca, cb = (mine.column(c).to_numpy()[near] for c in ("a", "b", "copies_a", "copies_b"))
                low = np.minimum(va, vb)
                cols = [np.concatenate(c) for c in ((va, vb), (cb, ca), (low, low))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["v", "n", "root"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _prepared(kind: np.dtype):
    """A vector's bytes, digest and first projection; null where it can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, labels, vectors = batch.columns
            rows = []
            for v in vectors:
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and v.values.null_count == 0 else np.empty(0, kind)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    rows.append((None,) * 4)
                    continue
                if len(x) not in first:
                    first[len(x)] = directions(len(x))[:, 0]
                raw = x.tobytes()
                rows.append((len(x), xxhash.xxh3_128_digest(raw), raw, float(unit(x[None])[0] @ first[len(x)])))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.float64()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([ids, labels, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=["vec_id", "label", "dim", "digest", "vec", "at"])

    return run


BLOCKS = "label long, dim int, block long, lo double, hi double, vs binary, copies binary, vecs binary"
MEMBERS = "block long, v long"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, vs in zip(*batch.columns, strict=True):
            v = np.frombuffer(vs.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), block.as_py())), pa.array(v)], names=["block", "v"])


def _block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    vs, copies = (np.array([r[k] for r in rows]).tobytes() for k in (3, 4))
    row = (*rows[0][:2], number, rows[0][2], rows[-1][2], vs, copies, b"".join(r[5] for r in rows))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])


def _blocks(size: int):
    """Cuts a sorted stream into blocks of one label and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                for r in zip(*(c.to_pylist() for c in batch.slice(i, size).columns), strict=True):
                    if held and (len(held) == size or held[0][:2] != r[:2]):
                        yield _block(number, held)
                        number, held = number + 1, []
                    held.append(r)
        if held:
            yield _block(number, held)

    return run


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """For each row of a and of b, in how many columns b lies in the window around a.

    Each column of b is sorted once; a window is then a range of ranks.
    """
    counts = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        line = b[order, k]
        rank = np.empty(len(b), np.uint16)
        rank[order] = np.arange(len(b), dtype=np.uint16)
        lo = np.searchsorted(line, a[:, k] - half, "left").astype(np.uint16)
        hi = np.searchsorted(line, a[:, k] + half, "right").astype(np.uint16)
        counts += (rank[None, :] - lo[:, None]) < (hi - lo)[:, None]
    return counts


def links(a: np.ndarray, b: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b linked to each other; of one block with itself, each pair once."""
    ua, ub, r = unit(a), unit(b), directions(a.shape[1])
    half, need = calibrated(a.shape[1], cosine)
    found = []
    for i in range(0, len(a), 256):
        counts = collisions(ua[i : i + 256] @ r, ub @ r, half)
        ia, ib = np.nonzero(counts >= need)
        ia += i
        if same:
            ia, ib = ia[ib > ia], ib[ib > ia]
        for k in range(0, len(ia), 1 << 14):
            x, y = ia[k : k + (1 << 14)], ib[k : k + (1 << 14)]
            near = np.einsum("ij,ij->i", ua[x], ub[y]) >= cosine
            found.append((x[near], y[near]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _linked(cosine: float, kind: np.dtype):
    """Of pairs of blocks: for each linked vector the rows linked to it here, and its least peer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b, dim, va, vb, ca, cb, xa, xb = (c[r].as_py() for c in batch.columns)
                same = a == b
                va, vb, ca, cb = (np.frombuffer(x, np.int64) for x in (va, vb, ca, cb))
                ia, ib = links(np.frombuffer(xa, kind).reshape(-1, dim), np.frombuffer(xb, kind).reshape(-1, dim), cosine, same)
                ids, copies = (va, ca) if same else (np.concatenate([va, vb]), np.concatenate([ca, cb]))
                ib = ib if same else ib + len(va)
                n = np.zeros(len(ids), np.int64)
                np.add.at(n, ia, copies[ib])
                np.add.at(n, ib, copies[ia])
                root = ids.copy()
                while True:
                    was = root.copy()
                    low = np.minimum(root[ia], root[ib])
                    np.minimum.at(root, ia, low)
                    np.minimum.at(root, ib, low)
                    if (was == root).all():
                        break
                has = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[has], pa.int64()) for x in (ids, n, root)], names=["v", "n", "root"])

    return run


def _small(df: DataFrame) -> DataFrame:
    df = cut(df)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _dense(hot: DataFrame, placed, cosine: float, kind: np.dtype, block: int) -> DataFrame:
    """Links among hot vectors, by pairs of blocks that share a window: v, n, root."""
    on = cut(placed(hot).select("v", "first", "key", "part", "x"))
    firsts = on.where("first").select("v", F.col("key").alias("line"), F.col("x").alias("place"))
    keys = ["label", "dim", "line", "place", "v"]
    order = hot.join(firsts, "v").select("label", "dim", "line", "place", "at", "v", "copies", "vec")
    cols = ["label", "dim", "at", "v", "copies", "vec"]
    blocks = cut(order.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*cols).mapInArrow(_blocks(block), BLOCKS))
    of = blocks.select("block", "vs").mapInArrow(_members, MEMBERS)
    held = cut(on.select("v", "key", "part").join(of, "v").select("key", "part", "block").distinct())
    near = held.select("key", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("block").alias("one"))
    pairs = near.join(held, ["key", "part"]).select(F.least("one", "block").alias("a"), F.greatest("one", "block").alias("b")).distinct()
    dims = blocks.select(F.col("block").alias("a"), "label", "dim").join(blocks.select(F.col("block").alias("b"), F.col("label").alias("l"), F.col("dim").alias("d")).join(pairs, "b"), "a")
    pairs = cut(dims.where("label = l AND dim = d").select("a", "b", "dim"))
    side = lambda x: blocks.select(F.col("block").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("vs", "copies", "vecs")))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "dim", "vs_a", "vs_b", "copies_a", "copies_b", "vecs_a", "vecs_b")
    return met.repartition(max(1, ceil(pairs.count() / TASK_PAIRS))).mapInArrow(_linked(cosine, kind), "v long, n long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98,
                    block: int = BLOCK) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id and kept.

    1. Equal vectors of a label are a class, represented by the smallest id; only classes go on, with their
       number of rows.
    2. Each class is a row on many lines (see Lines): sorted one-dimensional projections, within cells that a few more projections
       make. Windows are equi-joins: on each line of parts two half windows long, a query's window lies in two at most. What lies in it
       collides, and collisions are counted by pair. Pairs that reach the calibrated count are verified by cosine in double precision.
    3. Where a part of a line is crowded, by a group of near copies, the vectors around it are hot, and pairs of hot ones are not listed: hot vectors are sorted by
       a line and cut into blocks of bounded size, and blocks that share a window on any line are compared as a whole, by the
       collisions of 16 projections (see collisions), and verified. Of these links only each vector's number, and its least peer in the two
       blocks, leave the task: a group of g near copies gives g rows a pair of blocks, not g * g.
    4. Numbers are added up, and the peers' components found.

    Every pair is met in one of the two ways: in the first if one of it is not hot. The work for a vector grows with the number of its near
    copies, and with the logarithm of the label's size in tables; what is shuffled are ids and places, and vectors once per candidate pair or block pair.

    Ids are integers, unique over different vectors. Null labels, null ids, and vectors that are null, empty, zero or hold
    a null, NaN or infinity link with nothing. Vectors of different dimensions do not link. Repeated rows are
    copies of each other. Other columns are not read. An empty table gives no rows.
    """
    kind = np.dtype(np.float32 if dict(df.dtypes)[vector_col] == "array<float>" else np.float64)
    given = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    rows = given.mapInArrow(_prepared(kind), "vec_id long, label long, dim int, digest binary, vec binary, at double")
    rows = keep(rows.withColumn("links", F.col("digest").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    classes = cut(rows.where("links").groupBy("label", "dim", "digest")
                  .agg(F.min(F.struct("vec_id", "at", "vec")).alias("m"), F.count("*").alias("copies"))
                  .select("label", "dim", "digest", F.col("m.at").alias("at"), F.col("m.vec_id").alias("v"), "copies", F.col("m.vec").alias("vec")))
    most = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    lines = {r.dim: Lines.calibrated(r.dim, cosine, r.n) for r in most}
    part = F.floor(F.col("x") / 2)

    def placed(df: DataFrame) -> DataFrame:
        return df.select("v", "label", "dim", "vec", "hot").mapInArrow(_lines(lines, kind), LINES).withColumn("part", part)

    crowded = cut(placed(classes.withColumn("hot", F.lit(False))).groupBy("key", "part").count().where(F.col("count") > HOT).select("key", "part"))
    around = _small(crowded.select("key", F.explode(F.array(*(F.col("part") + k for k in (-1, 0, 1)))).alias("part")).distinct())
    hot = _small(placed(classes.withColumn("hot", F.lit(False))).join(around, ["key", "part"], "left_semi").select("v").distinct())
    told = cut(classes.join(hot.withColumn("hot", F.lit(True)), "v", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    # One by one: those that are not hot, with all.
    sides = F.explode(F.array_distinct(F.array(F.floor((F.col("x") - 1) / 2), F.floor((F.col("x") + 1) / 2))))
    asks = placed(told.where("NOT hot")).select("key", sides.alias("part"), F.col("x").alias("xa"), F.col("v").alias("a"))
    answers = placed(told).join(_small(crowded), ["key", "part"], "left_anti").select("key", "part", "x", F.col("v").alias("b"), "hot")
    met = asks.join(answers, ["key", "part"]).where((F.abs(F.col("x") - F.col("xa")) <= 1) & F.when(F.col("hot"), F.lit(True)).otherwise(F.col("a") < F.col("b")))
    pairs = met.groupBy("a", "b").count().where(F.col("count") >= NEEDED).select("a", "b")
    one = lambda x: told.select(F.col("v").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("label", "dim", "vec", "copies")))
    pairs = pairs.join(one("a"), "a").join(one("b"), "b").where("label_a = label_b AND dim_a = dim_b")
    sparse = pairs.select("a", "b", F.col("dim_a").alias("dim"), "vec_a", "vec_b", "copies_a", "copies_b").mapInArrow(_verified(cosine, kind), "v long, n long, root long")
    found = cut(sparse.unionByName(_dense(told.where("hot"), placed, cosine, kind, block)))
    n = found.groupBy("v").agg(F.sum("n").alias("n"))
    roots = connected(found, "v", "root").select(F.col("node").alias("v"), "root")
    of = classes.select("label", "dim", "digest", "v", "copies").join(n, "v", "left").join(roots, "v", "left").select(
        "label", "dim", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "v").alias("root"))
    alone = rows.where("NOT links").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rest = rows.where("links").join(of, ["label", "dim", "digest"]).select("vec_id", F.col("n").alias("n_links"), F.col("root").alias("component_id"))
    return rest.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
