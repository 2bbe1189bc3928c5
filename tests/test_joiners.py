import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import vectors as V
from kindred.operators import buckets, store, tiles, topk, windows
from kindred.operators import joiners as J
from kindred.operators.joiners import BlockedLsh, BucketLsh, ExactQueryJoin, ExactSelfJoin, HammingJoin
from kindred.operators.signatures import keyed_rounds

SCHEMA = "id long, vector array<double>"


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], SCHEMA)


def pairs(df):
    return {(r.i, r.j): r.value for r in df.collect()}


def near(got, want, tol=1e-9):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=tol)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    return table(spark, [(k, base[k % 12] + 0.5 * rng.standard_normal(16)) for k in range(150)]).repartition(5).cache()


THREE = [(0, (1, 1, 0, 0)), (1, (1, 2, 0, 0)), (2, (0, 1, 4, 2))]
QUERY = [(0, (1, 1)), (1, (-1, 1))]
CATALOG = [(0, (1, 1)), (1, (-1, 1)), (2, (-1, 0.5)), (3, (1, 0.5))]
FOUND = {(0, 0): 1.0, (0, 3): 1.5 / math.sqrt(2.5), (1, 1): 1.0, (1, 2): 1.5 / math.sqrt(2.5)}


def test_exact_self(spark):
    df = table(spark, [(0, (1, 0)), (1, (0, 1)), (2, (-1, 0)), (3, (1, 0))])
    near(pairs(ExactSelfJoin(0.0).join(df)), {(0, 1): 0, (0, 3): 1, (1, 2): 0, (1, 3): 0})
    near(pairs(ExactSelfJoin(0.0, V.Similarity(V.cosine)).join(df)), {(0, 1): 0, (0, 3): 1, (1, 2): 0, (1, 3): 0})


def test_exact_query(spark):
    near(pairs(ExactQueryJoin(0.4).join(table(spark, QUERY), table(spark, CATALOG))), FOUND)


@pytest.mark.parametrize("side", ["query", "catalog"])
def test_hamming(spark, side):
    got = pairs(HammingJoin(0.1, 10_000, 2, broadcast=side).join(table(spark, QUERY), table(spark, CATALOG)))
    near(got, FOUND, 0.02)


def test_hamming_limits_by_either_side(cloud):
    by_query = HammingJoin(-1.0, 64, 3).join(cloud, cloud).toPandas()
    by_catalog = HammingJoin(-1.0, 64, 3, limit_per="catalog").join(cloud, cloud).toPandas()
    assert (by_query.groupby("i").size() == 3).all() and (by_catalog.groupby("j").size() == 3).all()
    assert by_query.groupby("j").size().max() > 3


def test_blocked_lsh(spark):
    got = pairs(BlockedLsh(-1.0, 1000, 20, 2).join(table(spark, THREE)))
    near(got, {(0, 1): 3 / math.sqrt(10), (0, 2): 1 / math.sqrt(42), (1, 2): 2 / math.sqrt(105)})


def test_symmetric(cloud):
    for joiner in (ExactSelfJoin, lambda t, symmetric: BlockedLsh(t, 16, 12, 3, symmetric=symmetric)):
        one, two = (pairs(joiner(0.5, symmetric=s).join(cloud)) for s in (False, True))
        assert two == one | {(j, i): v for (i, j), v in one.items()} and len(two) == 2 * len(one)


def test_bucket_lsh_finds_itself(spark):
    df = table(spark, THREE)
    assert set(pairs(BucketLsh(-1.0, 100, 10, 1000, 10).join(df, df))) == {(0, 0), (1, 1), (2, 2)}


def test_lsh_is_a_part_of_the_exact_join(cloud):
    exact, found = pairs(ExactSelfJoin(0.5).join(cloud)), []
    for n in (1, 3, 8):
        found.append(pairs(BlockedLsh(0.5, 24, 12, n).join(cloud)))
        assert found[-1].items() and all(exact[k] == pytest.approx(v) for k, v in found[-1].items())
    assert found[0].keys() <= found[1].keys() <= found[2].keys() and len(found[2]) > 0.6 * len(exact)


def test_more_rounds_find_more(cloud):
    got = [pairs(BucketLsh(0.5, 5, 100, 100, n, salt_percentile=None).join(cloud, cloud)).keys() for n in (1, 4)]
    assert got[0] < got[1]


def test_salting_changes_nothing(spark, cloud):
    plain, salted = (BucketLsh(0.3, 3, 5, 4, 3, salt_percentile=p) for p in (None, 0.5))
    q = keyed_rounds(cloud, plain.planes(16))
    splits = buckets.splits(buckets.sizes(q, ["round", "sig_key"]), 0.5)
    assert splits.count() > 0
    assert buckets.salted(q, splits, 1).where("salt > 0").count() > 0
    assert pairs(plain.join(cloud, cloud)) == pairs(salted.join(cloud, cloud))


def test_flips(spark, cloud):
    q = keyed_rounds(cloud, BucketLsh(0, 6, 1, 1, 1).planes(16))
    rows = buckets.with_flips(q, 2, 6).collect()
    own = {r.id: r.sig_key for r in rows if r.flip < 0}
    flips = [(r.id, r.flip, r.sig_key) for r in rows if r.flip >= 0]
    assert len(flips) == 300 and len({x[:2] for x in flips}) == 300
    assert all(bytes([own[i][0] ^ (128 >> k)]) == bytes(key) for i, k, key in flips)
    assert buckets.with_flips(q, 99, 6).count() == 150 * 7


def test_each_row_is_in_one_block(cloud):
    rows = BlockedLsh(0.5, 16, 7, 3).blocks(cloud).select("round", "id", "block", "pos").toPandas()
    for _, g in rows.groupby("round"):
        assert sorted(g.pos) == list(range(150)) and g.id.is_unique and (g.groupby("block").size().head(-1) == 7).all()


def test_odd_vectors(spark):
    df = table(spark, [(0, (0, 0)), (1, (1, 1)), (2, (float("nan"), 1)), (3, (1, 1))])
    assert pairs(ExactSelfJoin(0.5).join(df)).keys() == {(1, 3)}
    assert pairs(ExactSelfJoin(0.0).join(df)).keys() == {(0, 1), (0, 3), (1, 3)}
    assert pairs(BlockedLsh(0.5, 8, 9, 1).join(df)).keys() == {(1, 3)}
    assert {(1, 1), (1, 3), (3, 1), (3, 3)} >= set(pairs(BucketLsh(0.5, 8, 9, 9, 2).join(df, df)))
    assert pairs(ExactSelfJoin(0.5, V.Similarity(V.cosine)).join(df)).keys() == {(1, 3)}


def test_empty(spark):
    none = table(spark, [(0, (1, 0))]).where("id < 0")
    some = table(spark, THREE)
    assert not pairs(ExactSelfJoin(0.1).join(none)) and not pairs(ExactQueryJoin(0.1).join(none, some)) and not pairs(HammingJoin(0.1, 8, 2).join(some, none))
    assert not pairs(BlockedLsh(0.1, 8, 4, 2).join(none)) and not pairs(BucketLsh(0.1, 4, 4, 4, 2).join(some, none))


def test_wrong_parameters(spark):
    df = table(spark, THREE)
    for call in (lambda: BlockedLsh(0, 4, 1, 1).join(df), lambda: BlockedLsh(0, 4, 2, 0).join(df), lambda: BucketLsh(0, 4, 1, 1, 0).join(df, df), lambda: BucketLsh(0, 4, 0, 1, 1).join(df, df),
                 lambda: topk.top_k(df, 0), lambda: HammingJoin(0, 4, 1, broadcast="none").join(df, df), lambda: windows.sliding(df, 1, 1)):
        with pytest.raises(ValueError):
            call()


def test_unequal_widths_fail(spark):
    df = table(spark, [(0, (1, 0)), (1, (1, 0, 0))])
    with pytest.raises(Exception, match="elements"):
        BlockedLsh(0, 4, 2, 1).join(df).collect()


def test_tiles_keep_all_rows(cloud):
    rows = tiles.tiles(cloud, 7).collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(150)) and max(len(r.ids) for r in rows) <= 7


@pytest.mark.parametrize(("size", "step"), [(5, 3), (3, 5), (4, 4), (2, 1), (1, 2)])
def test_sliding(spark, size, step):
    df = spark.range(23).withColumnRenamed("id", "pos")
    got = {}
    for r in windows.sliding(df, size, step).collect():
        got.setdefault(r.window, set()).add(r.pos)
    want = {k: set(range(k * step, min(k * step + size, 23))) for k in range(23) if k * step < 23 and (k == 0 or (k - 1) * step + size <= 22)}
    assert got == want


def test_distinct_and_top(spark):
    df = spark.createDataFrame([(1, 2, 3.4), (1, 2, 3.5), (1, 3, 3.4), (1, 4, 3.4), (2, 1, 0.0)], "i long, j long, value double")
    assert pairs(topk.distinct_pairs(df)) == {(1, 2): 3.5, (1, 3): 3.4, (1, 4): 3.4, (2, 1): 0.0}
    assert pairs(topk.distinct_top_k(df, 2)) == {(1, 2): 3.5, (1, 3): 3.4, (2, 1): 0.0}
    assert "WindowGroupLimit" in topk.top_k(df, 2)._jdf.queryExecution().executedPlan().toString()


def test_grid_gives_what_broadcasting_gives(spark, monkeypatch):
    """Tiles too large to broadcast go to the cells of a grid, with the same pairs, each once."""
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.standard_normal((300, 8)))], "id long, vector array<double>").repartition(5)
    joins = [lambda: J.ExactSelfJoin(0.3).join(v), lambda: J.ExactQueryJoin(0.4).join(v, v), lambda: J.HammingJoin(0.1, 100, 3).join(v, v),
             lambda: J.HammingJoin(0.1, 100, 3, broadcast="query", limit_per="catalog").join(v, v)]
    want = [sorted((r.i, r.j, round(r.value, 9)) for r in f().collect()) for f in joins]
    monkeypatch.setattr(tiles, "MOST_BROADCAST", 0)
    monkeypatch.setattr(tiles, "CELL", 2)
    real = tiles._gathered
    monkeypatch.setattr(tiles, "_gathered", lambda df, size, encode: real(df, 20, encode))
    assert [sorted((r.i, r.j, round(r.value, 9)) for r in f().collect()) for f in joins] == want
    assert all(want) and all("CartesianProduct" not in f()._jdf.queryExecution().toString() for f in joins)


def test_samples_are_the_same_when_drawn_again(spark):
    v = spark.range(20_000).selectExpr("id", "array(1d, 0d) AS vector")
    one, two = (sorted(r.id for r in J.sampled(df, 0.3, 5).collect()) for df in (v, v.repartition(7)))
    assert one == two and abs(len(one) / 20_000 - 0.3) < 0.02
    assert J.sampled(v, 0.3, 6).count() != 0 and sorted(r.id for r in J.sampled(v, 0.3, 6).collect()) != one


def test_symmetric_sample_keeps_pairs_of_larger_ids(spark):
    v = spark.createDataFrame([(k, [1.0, k / 50]) for k in range(40)], "id long, vector array<double>")
    chosen = {r.id for r in J.sampled(v, 0.3, 1).collect()}
    got = {(r.i, r.j) for r in J.ExactSelfJoin(-1, fraction=0.3, seed=1, symmetric=True).join(v).collect()}
    assert got == {(i, j) for i in range(40) for j in range(40) if i != j and (i in chosen or j in chosen)}


def test_validation(spark):
    wide = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vector array<double>")
    again = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "id long, vector array<double>")
    for v in (wide, again):
        with pytest.raises(ValueError):
            J.ExactSelfJoin(0.0, validate=True).join(v)
        with pytest.raises(ValueError):
            J.BlockedLsh(0.0, 4, 10, 1, validate=True).join(v)


def test_held_tables_are_released(spark):
    v = spark.createDataFrame([(k, [1.0, k / 50]) for k in range(40)], "id long, vector array<double>")
    store.release(spark)
    with store.scope(spark, "a join"):
        found = J.BucketLsh(0.0, 2, 100, 5, 2, salt_percentile=0.5).join(v, v)
        assert found.count() and store._held
    assert not store._held and found.count()


def test_recall_of_the_approximate_joins(spark):
    """Against the exact join, on vectors in clusters."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    rows = [(k, (centres[k % 60] + 0.35 * rng.standard_normal(32)).tolist()) for k in range(600)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    exact = {(r.i, r.j) for r in J.ExactSelfJoin(0.8).join(v).collect()}
    blocked = {(r.i, r.j) for r in J.BlockedLsh(0.8, 32, 100, 10).join(v).collect()}
    both = {(r.i, r.j) for r in J.ExactQueryJoin(0.8).join(v, v).collect()}
    bucket = {(r.i, r.j) for r in J.BucketLsh(0.8, 8, 1000, 1000, 16).join(v, v).collect()}
    assert blocked <= exact and len(blocked) >= 0.9 * len(exact), len(blocked) / len(exact)
    assert bucket <= both and len(bucket) >= 0.9 * len(both), len(bucket) / len(both)


def test_blocks_over_mostly_empty_partitions(spark):
    v = spark.createDataFrame([(k, [1.0, 0.0]) for k in (3, 4, 1, 2, 5)], "id long, vector array<double>").repartition(50)
    got = J.BlockedLsh(0.99, 2, 10, 1).join(v)
    assert sorted((r.i, r.j) for r in got.collect()) == [(i, j) for i in range(1, 6) for j in range(i + 1, 6)]


def test_block_pairs_at_a_minimum_of_one(spark):
    """Rows 3, 4 and 1 are (0, 1), row 2 is (1, 0); the minimum is exactly 1."""
    v = spark.createDataFrame([(3, [0.0, 1.0]), (4, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    got = sorted((r.i, r.j, r.value) for r in J.BlockedLsh(1.0, 2, 10, 1).join(v).collect())
    assert got == [(1, 3, 1.0), (1, 4, 1.0), (3, 4, 1.0)]
