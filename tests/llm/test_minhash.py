import random
import re
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kindred.llm import minhash, words


def plain(text, width=5):
    ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


@given(st.text(alphabet="aAbÉé \n\t\x0b\x1c\xa0", max_size=80))
def test_shingles(text):
    assert len(words.shingles(text)) == len(plain(text))


def brute(rows, percent=85):
    """The smallest linked id of every row, from all pairs."""
    sets = [(i, plain(t)) for i, t in rows]
    up = {i: i for i, s in sets if i is not None}
    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def made(seed):
    rng = random.Random(seed)
    text = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]
    rows, passage = [], text(60)
    def add(ws):
        rows.append((len(rows), " ".join(ws)))
    def changed(ws, k):
        ws = list(ws)
        for _ in range(k):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        return ws
    for n in (3, 8, 30, 64, 70, 120, 400):
        base = text(n)
        for k in range(9):
            add(changed(base, k * max(1, n // 100)))
    base = text(150)
    for k in range(90):
        add(changed(base, k % 5))
    for _ in range(60):
        add(changed(passage, rng.choice([0, 0, 1, 2])) + text(rng.choice([0, 2, 5, 80])))
    for _ in range(40):
        add(text(rng.choice([1, 4, 5, 6, 50])))
    rng.shuffle(rows)
    return rows


EDGE = [(None, "a b c d e f g"), (None, None), (5001, None), (5002, ""), (5003, " \n\t"), (5004, "a b c d e f g"), (5005, "A B\tc d e\nf g"),
        (5006, "a b c d e f g"), (5006, "a b c d e f g"), (5007, "One"), (5008, "one"), (5009, "long " * 3 + "w" * 200_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = made(seed) + EDGE
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, sketch string").repartition(3)
    got = minhash.NearDuplicates(df).groups().collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_long_lists_alone_find_all(spark, monkeypatch):
    """With no short lists every link has to come from the centres and the rest."""
    monkeypatch.setattr(minhash, "SHORT", 1)
    rows = made(3)
    got = minhash.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string")).groups().collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert minhash.NearDuplicates(spark.createDataFrame([], "doc_id long, text string")).groups().count() == 0


def test_frequent_driver(spark, monkeypatch):
    """The driver gets what is taken, not as much from each task; of equally frequent values a share is taken."""
    monkeypatch.setattr(minhash, "FREQUENT", 2000)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, live = {c: spark.conf.get(c) for c in conf}, spark.sparkContext._jsc.sc().conf()
    limit = live.get("spark.driver.maxResultSize", "1g")
    df = spark.range(0, 300_000, 1, 8).selectExpr("array(id % 100000, -1 - id % 500, 200000 + id) AS items")
    try:
        for c, x in conf.items():
            spark.conf.set(c, x)
        live.set("spark.driver.maxResultSize", "1m")
        known, counts = minhash.frequent(df, "items", 2)
    finally:
        live.set("spark.driver.maxResultSize", limit)
        for c, x in before.items():
            spark.conf.set(c, x)
    of = dict(zip(known.tolist(), counts.tolist(), strict=True))
    assert list(of) == sorted(of) and {x: n for x, n in of.items() if x < 0} == {-1 - x: 600 for x in range(500)}
    assert {n for x, n in of.items() if x >= 0} == {3} and max(of) < 100_000 and 1700 < len(of) < 2300
