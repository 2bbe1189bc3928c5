import hashlib
import zlib

import pytest

from kindred.llm import sharding


def walk(key: str, shards: int) -> int:
    at = last = step = 0
    while at < shards:
        draw = int(hashlib.md5(f"{key}:{step}".encode()).hexdigest()[:7], 16)
        last, at, step = at, (at + 1) * 2**28 // (draw + 1), step + 1
    return last


def test_matches_a_plain_walk(spark):
    rows = [(i, f"text é {i % 7}") for i in range(500)] + [(None, None), (None, "x"), (3, "text é 3"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(df, shards=24).collect()
    assert len(out) == len(rows)
    for r in out:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (walk(key, 24), walk(key, 25))
        assert r.grown_shard in (r.shard, 24)
    for k in range(24):
        slots = sorted(r.slot for r in out if r.shard == k)
        assert slots == list(range(len(slots)))
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r.text_crc32) for r in out) == want


def test_few_move_when_a_shard_is_added(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text", "1 AS shard", "2 AS slot")
    out = sharding.shard(df, shards=9).toPandas()
    assert 0.08 < (out.grown_shard != out.shard).mean() < 0.12
    assert out.groupby("shard").size().between(1900, 2600).all()


def test_empty_and_wrong(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        sharding.jump(spark.range(1).id, 0)


def test_very_long_texts_and_equal_rows(spark):
    rows = [(1, "x" * 3_000_000)] * 2 + [(2, "é" * 100_000), (2, None)] + [(7, "same")] * 300
    out = sharding.shard(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string"), shards=5).collect()
    assert sorted(r["size"] for r in out) == sorted(len((t or "").encode()) + 8 for _, t in rows)
    for k in range(5):
        slots = sorted(r.slot for r in out if r.shard == k)
        assert slots == list(range(len(slots)))
