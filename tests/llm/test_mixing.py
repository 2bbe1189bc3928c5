import random
import re

import pytest

from kindred.llm import mixing


def fill(sizes: dict, weights=(1, 2, 3), most=3):
    """Targets by filling up and sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        t = {s: most * sizes[s] if s in full else left * w[s] / share for s in names}
        over = {s for s in names if t[s] > most * sizes[s] + 1e-9}
        if not over:
            return t
        full |= over


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for s, n in (("a", 900), ("b", 300), ("é", 40), ("Z", 5), (None, 60), ("tiny", 1)):
        out += [(len(out) + k, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), s, 7, "x") for k in range(n)]
    return [*out, (None, "null id here", "a", 7, "x"), (4, None, "b", 7, "x"), out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, bucket string").repartition(5)


def test_targets_and_taken(spark, rows, docs):
    got = mixing.Mix(docs).taken().toPandas()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = fill(sizes)
    assert sorted(got["size"]) == sorted(count(r[1]) for r in rows)
    assert {(r.source_size, round(r.target, 6)) for r in got.itertuples()} == {(sizes[s], round(want[s], 6)) for s in sizes}
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for (_, target), g in got.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - target) <= max(1, g["size"].max() / 2)


def test_reruns_and_partitions_agree(docs):
    one, two = (sorted(map(tuple, mixing.Mix(d).taken().fillna(-1).collect())) for d in (docs, docs.repartition(3)))
    assert one == two


def test_documents_are_repeated_as_taken(docs):
    mix = mixing.Mix(docs)
    out = mix.documents(docs)
    assert out.columns == docs.columns
    words = out.select(mixing.words("text").alias("n")).toPandas().n
    assert words.sum() == mix.taken().toPandas().taken.sum() and (words > 0).all()


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.Mix(spark.createDataFrame([], schema)).taken().count() == 0
    got = mixing.Mix(spark.createDataFrame([(1, None, None), (2, " \n", "a")], schema)).taken().collect()
    assert [r.taken for r in got] == [0, 0] and [r.target for r in got] == [0.0, 0.0]


def test_full_share_of_ranks_is_even(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 9)) AS text", "if(id < 3000, 'a', 'b') AS source")
    got = mixing.Mix(df).taken().toPandas()
    a = got[got.source_size == got.source_size.max()]
    share = (a.taken > 0).groupby(a["size"]).mean()
    assert share.max() - share.min() < 0.2


def odds(sizes, quota, lean):
    """Inclusion probabilities by bisection of the level."""
    g = [2 ** (lean * (n.bit_length() - 1)) for n in sizes]
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1, mid * a) * n for a, n in zip(g, sizes, strict=True)) < quota else (lo, mid)
    return [min(1, hi * a) for a in g]


@pytest.mark.parametrize("lean", [0.2, 1.0])
def test_inclusion_frequencies(spark, lean):
    """Each source is a replicate of the same documents; two in three sample half of their words, a seed each."""
    rng, copies = random.Random(8), 600
    sizes = [rng.choice([3, 9, 20, 50, 100, 400]) for _ in range(120)] + [6000]
    rows = [(r * 1000 + k, n, f"s{r:03}") for r in range(copies) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, n int, source string").selectExpr("doc_id", "repeat('w ', n) AS text", "source")
    got = mixing.Mix(df, lean=lean).taken().toPandas()
    want = odds(sizes, sum(sizes) / 2, lean)
    assert max(want) > min(want) + 0.25 and (lean < 1 or max(want) == 1)
    got["r"], got["k"] = got.doc_id // 1000, got.doc_id % 1000
    got = got[got.r % 3 != 1]
    extra = got.taken // got["size"] - (got.r % 3 == 2)
    assert set(extra.unique()) == {0, 1}
    mean, n = extra.groupby(got.k).mean(), 2 * copies // 3
    for k, p in enumerate(want):
        assert abs(mean[k] - p) <= 4.5 * (p * (1 - p) / n) ** 0.5 + 0.03, (k, sizes[k], p, mean[k])
    # by length class, where noise is small
    for s in set(sizes):
        ks = [k for k, x in enumerate(sizes) if x == s]
        p = want[ks[0]]
        assert abs(mean[ks].mean() - p) <= 0.03 + 4.5 * (p * (1 - p) / n / len(ks)) ** 0.5, (s, p, mean[ks].mean())


def test_long_text_and_copies_at_the_end(spark):
    """A text as long as the rest of its source, and one row many times: the targets still hold."""
    rows = [(1, "w " * 200_000, "a")] + [(2, "x y z", "b")] * 5000 + [(k, "w " * 40, "c") for k in range(10, 4000)]
    got = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).taken().toPandas()
    for target, g in got.groupby("target"):
        assert abs(g.taken.sum() - target) <= max(1, g["size"].max() / 2) and (g.taken <= 3 * g["size"]).all()
