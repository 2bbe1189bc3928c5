import gzip
import hashlib
import random
import zlib
from pathlib import Path
from urllib.parse import urlparse

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kindred.llm import warc


@given(st.binary(max_size=3000), st.integers(1, 700))
def test_chunks_round_trip(data, size):
    assert warc.unchunked(warc.chunked(data, size)) == data


@pytest.mark.parametrize("bad", [b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n0\r\nx", b"0\r\n",
                                 b"-2\r\nabc\r\n0\r\n\r\n", b"0x3\r\nabc\r\n0\r\n\r\n", b"+3\r\nabc\r\n0\r\n\r\n", b" 3\r\nabc\r\n0\r\n\r\n", b"1_0\r\n0123456789abcdef\r\n0\r\n\r\n", b"\r\nabc"])
def test_broken_chunks(bad):
    with pytest.raises(ValueError):
        warc.unchunked(bad)


ROWS = [
    (5, "http://a/ü\r\nX: y", "é" * 200), (2, "http://a/2", "é" * 200), (9, None, "é" * 200), (1, "u", None), (3, "u", "short"), (4, "u", "short"),
    (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 9), (7, "u", "".join(random.Random(1).choices("abc \n中", k=9000))),
    (None, "u", "é" * 200), (8, "u", ""), (7, "u", "".join(random.Random(1).choices("abc \n中", k=9000))),
]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, digest int, payload string")
    warc.write(df, str(tmp_path / "w"), segment=1000)
    archive = warc.read(spark, str(tmp_path / "w"))
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) for r in warc.summary(archive).collect()}
    first: dict = {}
    for i, _, h in ROWS:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = set()
    for i, _, h in ROWS:
        b = (h or "").encode()
        ref = first.get(h) if len(b) >= 100 and first.get(h) != i else None
        want.add((i, len(b), hashlib.sha256(b).hexdigest(), "response" if ref is None else "revisit", ref, None))
    assert got == want and archive.count() == len(ROWS)
    parts = [p for f in (tmp_path / "w").glob("part*") for p in warc.parse(f.read_bytes())]
    assert sum(p[1] == "continuation" for p in parts) >= 18 and all(len(p[-1]) <= 1000 for p in parts)
    assert all(r.payload.decode() == "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 9 for r in archive.where("record_id LIKE 'urn:page:6:%'").collect())


def test_broken_segments(spark, tmp_path):
    text = "x" * 5000
    def saved(name, change):
        parts = list(warc.records(f"urn:page:{name}:d:1", None, text.encode(), hashlib.sha256(text.encode()).hexdigest(), None, "d", 1000))
        (tmp_path / f"{name}.warc.gz").write_bytes(gzip.compress(b"".join(x + b"\r\n\r\n" for x in change(parts))))
    saved(1, lambda p: p[::-1])
    saved(2, lambda p: p[:2] + p[3:])
    saved(3, lambda p: [*p, p[1]])
    saved(4, lambda p: p[:-1])
    saved(5, lambda p: [p[0].replace(b"xxxx", b"xxyx", 1), *p[1:]])
    got = {r.page_id: r.error for r in warc.summary(warc.read(spark, str(tmp_path))).collect()}
    assert got[1] is None and "missing" in got[2] and "repeated" in got[3] and "total" in got[4] and "digest" in got[5]


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.summary(warc.read(spark, str(tmp_path / "w"))).count() == 0


def test_pages_have_continuations(spark, tmp_path):
    """Of the test table, as the query writes it."""
    from kindred.llm.queries import SEGMENT

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    warc.write(pages, str(tmp_path / "w"), segment=SEGMENT)
    files = list((tmp_path / "w").glob("part*"))
    assert files and all(f.name.endswith(".warc.gz") for f in files)
    kinds = [p[1] for f in files for p in warc.parse(f.read_bytes())]
    origins = {p[5] for f in files for p in warc.parse(f.read_bytes()) if p[1] == "continuation"}
    assert kinds.count("response") + kinds.count("revisit") == pages.count()
    assert len(origins) > 0.5 * kinds.count("response") and kinds.count("continuation") > len(origins)
    want = {r.page_id: r.html or "" for r in pages.collect()}
    got = {int(r.record_id.split(":")[2]): r.payload.decode() for r in warc.read(spark, str(tmp_path / "w")).where("type = 'response'").collect()}
    assert all(want[k] == v for k, v in got.items()) and len(got) == kinds.count("response")


def test_a_member_per_record(spark, tmp_path):
    warc.write(spark.createDataFrame([(k, "u", "x" * 3000) for k in range(3)], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), segment=1000)
    (file,) = (tmp_path / "w").glob("part*")
    data, members = file.read_bytes(), []
    while data:
        d = zlib.decompressobj(31)
        members.append(d.decompress(data))
        data = d.unused_data
    full = [m for m in members if m]
    assert len(full) == 6 and all(m.startswith(b"WARC/1.1") and m.endswith(b"\r\n\r\n") and len(list(warc.parse(m))) == 1 for m in full)


def test_broken_files(spark, tmp_path):
    good = next(iter(warc.records("urn:page:1:d:1", None, b"abc", hashlib.sha256(b"abc").hexdigest(), None, "d", 1000))) + b"\r\n\r\n"
    for name, data in {"a": b"nonsense", "b": gzip.compress(good) + b"\x1f\x8b\x08broken", "c": gzip.compress(good)[:-9], "d": good + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc",
                       "e": b"", "f": good.replace(b"Content-Length", b"Content-Lengths")}.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.error.split(":")[1].rsplit("/", 1)[-1] for r in rows if r.error) == [f"{x}.warc.gz" for x in "abcdf"]
    assert [r.payload for r in rows if not r.error] == [b"abc"]


def test_payload_over_the_real_segment(spark, tmp_path):
    text = "".join(random.Random(4).choices("abcdefgh ", k=3 * warc.SEGMENT))
    warc.write(spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string"), str(tmp_path / "w"))
    (row,) = warc.read(spark, str(tmp_path / "w")).collect()
    assert row.error is None and row.payload.decode() == text


def test_segments_in_other_files(spark, tmp_path):
    """Segments meet wherever they are."""
    texts = {k: "".join(random.Random(k).choices("abcdefgh ", k=5000)) for k in range(1, 6)}
    parts = [x + b"\r\n\r\n" for k, t in texts.items() for x in warc.records(f"urn:page:{k}:d:1", None, t.encode(), hashlib.sha256(t.encode()).hexdigest(), None, "d", 1000)]
    random.Random(1).shuffle(parts)
    for k in range(3):
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts[k::3]))
    got = {int(r.record_id.split(":")[2]): (r.payload.decode(), r.error) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {k: (t, None) for k, t in texts.items()}


def test_small_segments_share_files(spark, tmp_path):
    """Files are no more than their bytes ask for: each starts processes on the executors that write it."""
    pages = spark.range(20).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 1000000) AS html").coalesce(1)
    warc.write(pages, str(tmp_path / "w"), segment=1024)
    files = [warc.gunzip(f.read_bytes()) for f in (tmp_path / "w").glob("part*")]
    assert len(files) < 9 and all(len(f) <= warc.FILE_BYTES for f in files)
    assert sum(len(list(warc.parse(f))) for f in files) > 20 * warc.FILE_RECORDS
    got = {r.page_id: (r.payload_bytes, r.error) for r in warc.summary(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert got == {k: (1000000 * len(str(k)), None) for k in range(20)}


def test_write_leaves_nothing_but_the_archive(spark, tmp_path):
    """Tables in between are the executors' own until it is written: files of them would start as many processes as the archive's."""
    from kindred.llm.common import shared_dir

    shared_dir(spark)
    shared = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    state = lambda: {str(p) for p in shared.rglob("*")} | set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before = state()
    warc.write(spark.createDataFrame([(k, "u", "x" * 300) for k in range(9)], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert shared.is_dir() and not state() - before
    got = warc.summary(warc.read(spark, str(tmp_path / "w"))).select("record_type", "refers_to").collect()
    assert sorted((r.record_type, r.refers_to) for r in got) == [("response", None), *[("revisit", 0)] * 8]
