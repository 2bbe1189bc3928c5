import numpy as np
import pytest

from kindred.llm import embeddings


def brute(rows, cosine=0.98):
    ok = lambda x: x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x)
    n, up = [0] * len(rows), list(range(len(rows)))
    def find(k):
        while up[k] != k:
            k = up[k]
        return k
    for i, (a, la, x) in enumerate(rows):
        for j, (b, lb, y) in enumerate(rows[:i]):
            if None in (a, b, la, lb) or la != lb or not ok(x) or not ok(y) or len(x) != len(y):
                continue
            u, v = np.array(x, float), np.array(y, float)
            if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= cosine:
                n[i] += 1
                n[j] += 1
                up[find(i)] = find(j)
    least: dict = {}
    for k, (a, *_) in enumerate(rows):
        if a is not None:
            least[find(k)] = min(a, least.get(find(k), a))
    return sorted(((a, n[k], None if a is None else least[find(k)]) for k, (a, *_) in enumerate(rows)), key=str)


def made(dim, seed=0):
    rng = np.random.default_rng(seed)
    f = lambda x: [float(c) for c in np.float32(x)]
    rows = []
    for k in range(220):
        rows.append((len(rows), k % 3, f(rng.standard_normal(dim))))
    for spread in (0.0, 0.1, 0.18, 0.2, 0.22):
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(30):
            step = rng.standard_normal(dim)
            rows.append((len(rows), 1, f(3 * (base + spread * step / np.linalg.norm(step)))))
    bad = [None, [], [0.0] * dim, [None, *[1.0] * (dim - 1)], [float("nan")] * dim, [float("inf"), *[1.0] * (dim - 1)], [1.0, 2.0]]
    rows += [(len(rows) + k, 1, x) for k, x in enumerate(bad + bad)]
    return rows + [(None, 1, rows[0][2]), (9999, None, rows[0][2]), (9998, None, rows[0][2]), (5, rows[5][1], rows[5][2]), rows[5]]


@pytest.mark.parametrize(("dim", "block", "hot"), [(64, 1024, 64), (64, 16, 8), (3, 50, 20), (8, 1024, 1), (64, 100, 10_000)])
def test_equals_all_pairs(spark, monkeypatch, dim, block, hot):
    monkeypatch.setattr(embeddings, "HOT", hot)
    rows = made(dim, seed=dim)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, n int, digest string")
    got = embeddings.near_duplicates(df.repartition(3), block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_doubles_and_empty(spark):
    rows = [(1, 0, [1e300, 1.0]), (2, 0, [1e300, 0.0]), (3, 0, [0.0, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r) for r in embeddings.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_calibration_finds_pairs_at_the_bound():
    rng = np.random.default_rng(1)
    a = embeddings.unit(rng.standard_normal((3000, 64)))
    step = rng.standard_normal((3000, 64))
    step = embeddings.unit(step - (step * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * step
    half, need = embeddings.calibrated(64, 0.98)
    hits = (np.abs((a - b) @ embeddings.directions(64)) <= half).sum(1)
    far = embeddings.collisions(a[:500] @ embeddings.directions(64), b[500:1000] @ embeddings.directions(64), half)
    assert (hits >= need).all() and (far >= need).mean() < 0.01


@pytest.mark.parametrize(("dim", "n"), [(64, 1000), (64, 100_000), (16, 3000), (2, 500), (384, 10**7)])
def test_lines_find_pairs_at_the_bound(dim, n):
    """Recall right at cosine 0.98, and few pairs by chance."""
    rng = np.random.default_rng(dim)
    a = embeddings.unit(rng.standard_normal((4000, dim)))
    step = rng.standard_normal((4000, dim))
    step = embeddings.unit(step - (step * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * step
    of = embeddings.Lines.calibrated(dim, 0.98, n)
    (ka, xa), (kb, xb) = (of.placed(x, of.drawn()) for x in (a, b))
    assert (((ka == kb) & (np.abs(xa - xb) <= 1)).sum(1) >= embeddings.NEEDED).all()
    far = ((ka[:2000] == kb[2000:]) & (np.abs(xa[:2000] - xb[2000:]) <= 1)).sum() / 2000 / of.tables
    assert dim < 32 or far * n <= 20 * embeddings.TARGET


def test_work_is_flat_at_fixed_density():
    """Rows on lines for a vector, a thousand times as many vectors: tables grow as a small power of the number."""
    tables = [embeddings.Lines.calibrated(64, 0.98, n).tables for n in (10**4, 10**7)]
    assert tables[1] <= 4 * tables[0]
