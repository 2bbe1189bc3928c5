import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from kindred.llm import packing

PATH = packing.tokenizer_path()
PLAIN, ENCODER = Tokenizer.from_file(PATH), packing.Encoder(PATH, packing.tokenizer_path("byte_bpe_50k.tiktoken"))


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab'sé 中1!  \n\t \x1c\x85 ​", max_size=40))
def test_both_libraries_agree(text):
    assert ENCODER.encode(text).tolist() == ids(text)[:-1]


@given(st.lists(st.sampled_from(["it's", " ", "  ", "<|endoftext|>", "'ll", "\n", " x", "　"]), max_size=12))
def test_odd_joints(parts):
    text = "".join(parts)
    assert ENCODER.encode(text).tolist() == ids(text)[:-1]


def test_all_letters_and_long_runs():
    letters = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(letters), 400):
        text = "".join(f"a{c}b {c}1 \n{c} {c}x{c}{c}" for c in map(chr, letters[i : i + 400]))
        assert ENCODER.encode(text).tolist() == ids(text)[:-1]
    for text in (" " * 60_000 + "a", "x" * 60_000, "\n " * 30_000 + "b"):
        assert ENCODER.encode(text).tolist() == ids(text)[:-1]


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["tree", "cloud", "of", "the", f"n{k % 50}"]) for _ in range(rng.choice([0, 3, 80, 400, 3000])))) for k in range(400)]
    rows += [(1000 + k, "the same text of many copies " * 40) for k in range(150)]
    rows += [(None, "null id"), (2000, None), (2001, ""), (2002, "x" * 50_000), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, length int, ids binary").repartition(4)
    return rows, packing.pack(df).toPandas()


def test_each_id_once(packed):
    rows, out = packed
    want: dict = {}
    for k, t in rows:
        want.setdefault(k, []).append(np.array(ids(t), "<u4"))
    assert out.length.sum() == sum(len(x) for xs in want.values() for x in xs)
    for k, g in out.assign(doc_id=out.doc_id.astype(object).where(out.doc_id.notna(), None)).groupby("doc_id", dropna=False):
        k = None if k != k else int(k)
        at = 0
        copies = len(want[k])
        for p in g.sort_values(["start", "length"]).drop_duplicates("start").itertuples() if copies == 1 else ():
            assert p.start == at and p.doc_tokens == len(want[k][0])
            assert p.ids_crc32 == zlib.crc32(want[k][0][at : at + p.length].tobytes())
            at += p.length
        assert copies > 1 or at == len(want[k][0])


def test_sequences(packed):
    _, out = packed
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024
    sizes = out.groupby("sequence_id").length.sum()
    assert (sizes < 1024).sum() <= 4


def bm25(rows, n_ids):
    """Scores of all documents (columns) for all as queries (rows), with all terms of whole documents, and of each for itself."""
    bags = [np.unique(x, return_counts=True) for x in n_ids]
    sizes = np.array([len(x) for x in n_ids])
    tf = np.zeros((len(rows), max(b[0].max() for b in bags) + 1))
    for k, (term, count) in enumerate(bags):
        tf[k, term] = count
    df = (tf > 0).sum(axis=0)
    long = 1 - packing.B + packing.B * sizes[:, None] / sizes.mean()
    weights = np.log1p((len(rows) - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * long)
    return (tf > 0) @ weights.T, weights.sum(axis=1)


@pytest.mark.parametrize("dense", [0, 20, 5000])
def test_retrieval_over_all_shards(spark, monkeypatch, dense):
    """Every document goes to the seed that is best by brute force, whatever shard it is in."""
    for name, value in {"SHARD": 40, "BLOCK": 16, "SEEDS": 4, "DENSE": dense}.items():
        monkeypatch.setattr(packing, name, value)
    rng = random.Random(5)
    kinds = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(30)]
    rows = [(k, " ".join(rng.choice(kinds[k % 30]) if rng.random() < 0.5 else f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 150, 900])))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    encoded, n, dtype, held = packing.corpus(docs, "doc_id", "text", PATH, packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    doc = {r.row: r.doc_id for r in encoded.collect()}
    got = {doc[r.row]: (doc[r.seed], r.best) for r in packing.retrieved(encoded, n, dtype, held, 10).collect()}
    scores, own = bm25(rows, [ids(t) for _, t in rows])
    assert max(len(ids(t)) for _, t in rows) > 1024 and len(got) == n
    seeds = np.arange(0, 300, 10)
    alike = scores[seeds] / (own[seeds][:, None] + own[None, :])
    right = sum(got[k][0] == seeds[alike[:, k].argmax()] for k in got)
    assert right >= 0.99 * n
    assert all(abs(got[k][1] - alike[:, k].max()) < 1e-4 for k in got)


def test_neighbours_share_windows(spark):
    """Documents of one kind of words lie together: in windows with others of their kind."""
    rng = random.Random(9)
    kinds = [[f"k{k}x{rng.randrange(10**6)}" for _ in range(40)] for k in range(20)]
    rows = [(k, " ".join(rng.choice(kinds[rng.randrange(20) if k >= 1000 else (k // 50) % 20]) for _ in range(60))) for k in range(1000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    out["kind"] = (out.doc_id // 50) % 20
    kinds_in = out.groupby("sequence_id").kind.nunique()
    assert kinds_in.mean() < 1.5


def test_filling():
    docs = [(0, 0, 1500), (1, 0, 300), (2, 0, 300), (3, 0, 2000), (4, 0, 1), (5, 0, 0)]
    got = list(packing.filled(docs))
    assert got == [[(0, 0, 1024)], [(0, 1024, 476), (1, 0, 300), (4, 0, 1), (2, 0, 247)], [(2, 247, 53), (3, 0, 971)], [(3, 971, 1024)], [(3, 1995, 5)]]
    one = list(packing.filled(docs, look=1))
    assert [x for w in one for x in w] == [(0, 0, 1024), (0, 1024, 476), (1, 0, 300), (2, 0, 248), (2, 248, 52), (3, 0, 972), (3, 972, 1024), (3, 1996, 4), (4, 0, 1)]


def test_ties_and_no_seeds(spark):
    """Equal documents, ids that repeat over different texts, and a table without a seed: every id once."""
    rows = [(1, "a b c")] * 500 + [(2, "a b c"), (2, "x y z"), (3, "w " * 30_000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).toPandas()
    assert out.length.sum() == sum(len(ids(t)) for _, t in rows)
    pieces = out[out.doc_id == 3].sort_values("start")
    assert (pieces.start == pieces.length.cumsum() - pieces.length).all() and pieces.length.sum() == len(ids(rows[-1][1]))
    sizes = out.groupby("sequence_id").length.sum()
    assert (sizes < 1024).sum() <= 1 and sizes.max() <= 1024


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
