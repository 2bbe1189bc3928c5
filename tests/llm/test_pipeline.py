"""Each stage of the pipeline on what the one before it kept, against brute-force versions."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from kindred.llm import packing, quality

from .test_minhash import brute
from .test_minhash import plain as plain_shingles
from .test_mixing import fill
from .test_quality import plain as counts
from .test_templates import plain as lines_left

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = [(None, None, None, None, None), (900_001, None, "en", "a", 0), (900_002, "", None, "src1", 0), (900_003, "the of and " * 4000, "en", None, 1)]
    more = spark.createDataFrame(extra, docs.schema).unionByName(docs.where("doc_id = 2"))
    docs = docs.unionByName(more).repartition(3)
    top, seen = tmp_path_factory.mktemp("stages"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{top}/{k}")
        after = spark.read.parquet(f"{top}/{k}")
        seen.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return seen


def distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_columns(stages):
    assert all(cols == COLUMNS for _, _, cols in stages[:4])
    assert all(before and after for before, after, _ in stages)


def test_quality(stages):
    before, after, _ = stages[0]
    tables, rows, means = quality._tables(), [], {}
    for r in before:
        lang = r.lang if r.lang in quality.COMMON else quality.REST
        n, *_, repeated = counts(r.text)
        hists = [[x / max(1, sum(h)) for x in h] for h in quality.measure(r.text, lang, tables)[5:]]
        failed = n < 10 or 100 * repeated > 20 * n
        rows.append((r, lang, n, failed, hists))
        if not failed and n >= quality.MIN_WORDS_WORDS:
            means.setdefault(lang, []).append(hists)
    want = Counter()
    for r, lang, n, failed, hists in rows:
        far = False
        for k, (least, limit) in enumerate(((quality.MIN_WORDS_CHARS, quality.MAX_CHARS), (quality.MIN_WORDS_WORDS, quality.MAX_WORDS))):
            if n >= least and lang in means:
                ref = np.mean([h[k] for h in means[lang]], axis=0)
                far |= distance(hists[k], ref) > limit[0] + limit[1] / math.sqrt(n)
        if not failed and not far:
            want[tuple(r)] += 1
    assert Counter(map(tuple, after)) == want and len(after) < len(before)


def test_line_dedup(stages):
    before, after, _ = stages[1]
    left = lines_left([(r.doc_id, r.text) for r in before])
    want = sorted(((i, t) for i, t, _, gone in left if not gone or t.split()), key=str)
    assert sorted(((r.doc_id, r.text) for r in after), key=str) == want
    assert any(gone for *_, gone in left)


def test_near_dedup(stages):
    before, after, _ = stages[2]
    of = brute([(r.doc_id, r.text) for r in before], pipeline.NEAR)
    assert sorted(r.doc_id for r in after) == sorted({i for i, _, c in of if i == c})
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_near_dedup_bound(spark):
    """Pairs between 0.80 and 0.85 are near copies; different texts of one id stay or go together, equal ones collapse."""
    base = [f"w{k}" for k in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:50], "x", *base[51:], *"abcdefghij"])), (3, " ".join([*base[:40], *"klmnopqr", *base[48:]]))]
    rows += [(5, "one text of the id five " + " ".join(base[:9])), (5, "quite another one of this id"), (5, "quite another one of this id"), (None, "no id"), (None, "no id")]
    sets = [plain_shingles(t) for _, t in rows]
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= sim(0, 1) < 0.85 and sim(0, 2) < 0.8
    df = spark.createDataFrame([(i, t, "en", s, 1) for k, (i, t) in enumerate(rows) for s in [f"s{k}"]], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text, r.source) for r in pipeline.near_dedup(spark, df.repartition(3), "").collect()), key=str)
    assert got == sorted([(1, rows[0][1], "s0"), (3, rows[2][1], "s2"), (5, rows[3][1], "s3"), (5, rows[4][1], "s4"), (None, "no id", "s6"), (None, "no id", "s7")], key=str)


def test_clashing_columns_and_long_texts(spark):
    """All stages but the last carry other columns, whatever their names, and whole texts."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    long = docs.where("length(text) > 2000").limit(1).selectExpr("990000 AS doc_id", "repeat(concat(text, ' '), 1) AS text", "lang", "source", "n_chars")
    more = {c: F.lit(k) for k, c in enumerate(["id", "size", "key", "kept", "times", "place", "hash", "n", "v", "row"])}
    df = docs.unionByName(long).withColumns(more)
    for _, stage in pipeline.STAGES[:4]:
        out = stage(spark, df, DIR)
        assert out.columns == df.columns and out.count() > 0
    assert pipeline.STAGES[4][1](spark, df, DIR).count() > 0


def test_mixing(stages):
    before, after, _ = stages[3]
    words = lambda t: len((t or "").encode().split())
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += words(r.text)
        most[r.source] = max(most[r.source], words(r.text))
    for r in after:
        taken[r.source] += words(r.text)
    for s, target in fill(dict(sizes)).items():
        assert abs(taken[s] - target) <= most[s] / 2 + 1
    copies = Counter(map(tuple, after))
    assert copies.keys() <= {tuple(r) for r in before} and max(copies.values()) <= 3


def test_packing(stages):
    before, after, _ = stages[4]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    held, want = Counter(), Counter()
    for r in before:
        want[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    for p in after:
        held[p.doc_id] += p.length
    assert held == want
    texts = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in before}
    assert all(p.ids_crc32 == zlib.crc32(texts[p.doc_id][p.start : p.start + p.length].tobytes()) for p in after)
    full = Counter()
    for p in after:
        full[p.sequence_id] += p.length
    assert max(full.values()) <= 1024 and sum(x < 1024 for x in full.values()) <= 8


def test_run(spark):
    assert pipeline.run(spark, DIR).agg(F.count("*")).first()[0] > 0


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
