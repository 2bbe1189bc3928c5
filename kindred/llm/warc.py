"""WARC archives: writing records in segments, and putting segments together again."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep

#: A record's block has this many bytes at most; what is longer goes on in continuation records.
SEGMENT = 64 << 10
#: So many records of that size a file, which fits a worker, unpacked.
FILE_RECORDS = 1000
#: Of smaller segments a file has more records, up to so many bytes, unpacked; HEAD is for a record's header.
FILE_BYTES = 8 << 20
HEAD = 512
CHUNK = 4096
#: Payloads from this size on are stored once.
LEAST_SHARED = 100
#: Tables of up to so many revisits (some 100 bytes a row) are broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 100_000

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: A gzip member of no bytes: what the text writer puts behind each row, so behind each record's member.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_CHUNK_SIZE = re.compile(rb"[0-9A-Fa-f]+")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) if (p := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; a ValueError if the framing is broken or goes on after the end."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        digits = body[at:stop].split(b";")[0].rstrip(b" \t")
        if not _CHUNK_SIZE.fullmatch(digits):
            raise ValueError("a chunk's size is not a hexadecimal number")
        size = int(digits, 16)
        at = stop + 2 + size
        if size == 0:
            trailer = body[stop + 2 :]
            if trailer != b"\r\n" and not trailer.endswith(b"\r\n\r\n"):
                raise ValueError("unended trailer")
            return b"".join(out)
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        out.append(body[at - size : at])
        at += 2


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """An HTTP response's payload, and its Content-Length if it states one."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP headers")
    fields = dict(_field(x) for x in head.decode("latin-1").split("\r\n")[1:])
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunked(body)
    return body, int(fields["content-length"]) if "content-length" in fields else None


def _field(line: str) -> tuple[str, str]:
    name, _, value = line.partition(":")
    return name.strip().lower(), value.strip()


def _safe(uri: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in uri)


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(record_id: str, uri: str | None, payload: bytes, digest: str, refers: str | None, date: str, segment: int) -> Iterator[bytes]:
    """A page's records: a revisit, or a response and its continuations."""
    own = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", None if uri is None else _safe(uri))]
    http = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers is not None:
        block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _record([("WARC-Type", "revisit"), *own, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>"), *http], block)
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), *own, *http], block)
        return
    for k, part in enumerate(parts, 1):
        where = [("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)]
        if k == 1:
            yield _record([("WARC-Type", "response"), *own, *http, *where], part)
        else:
            ids = [("WARC-Record-ID", f"<{record_id}:{k}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>")]
            yield _record([("WARC-Type", "continuation"), *ids, *own[1:], *where], part)


def file_records(segment: int) -> int:
    """Records a file: files of small segments would else be many and tiny, and each costs the writer processes of its own (README)."""
    return max(FILE_RECORDS, FILE_BYTES // (segment + HEAD))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT) -> None:
    """Writes a record per row, as .warc.gz files of file_records(segment) records at most, each record a gzip member of its own.

    Between the members stands an empty one, which readers of gzip skip: the text writer ends each row with something.

    Of rows with equal payloads of LEAST_SHARED bytes or more, those with the smallest id are responses and the
    others revisit it. Which, is found on digests alone, and the payloads are moved once, by the id. Record
    ids are urn:page:<id>:<digest's start>:<n>, n counting repeated rows.

    Nulls: a null payload is empty; a null url leaves the field out; a null id is written as "null", and is no
    group's smallest. Repeated rows, and rows of equal ids, are records each; of those with the group's smallest id, all are responses. A
    very long payload is one row in memory, as a whole and as its records, whose blocks have `segment` bytes at most. Other columns are
    not read. An empty table gives an empty archive.
    """
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("pid"), F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    ids = rows.select("pid", "id", "digest", (F.octet_length("payload") >= LEAST_SHARED).alias("shared")).groupBy("pid", "id", "digest", "shared").count()
    ids = keep(ids)
    first = ids.where("shared").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = ids.join(first, "digest", "left").withColumn("first", F.when(F.col("shared") & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")))
    # Rows that revisit or repeat another; of the others the payload need not be moved to know what they are.
    odd = keep(seen.where("first IS NOT NULL OR count > 1").select("pid", "digest", "first", "count"))
    rows = rows.join(F.broadcast(odd) if odd.count() <= MOST_BROADCAST else odd, ["pid", "digest"], "left")
    cols = ["pid", "url", "payload", "digest", "first"]
    nth = F.row_number().over(W.partitionBy("pid", "digest").orderBy("url"))
    rows = rows.where("count IS NULL OR count = 1").select(*cols, F.lit(1).alias("nth")).unionByName(rows.where("count > 1").select(*cols, nth.alias("nth")))
    urn = lambda pid, n: F.concat_ws(":", F.lit("urn:page"), pid, F.substring("digest", 1, 16), n)
    rows = rows.select(urn("pid", "nth").alias("record_id"), "url", "payload", "digest",
                       F.when(F.col("first").isNotNull(), urn(F.col("first").cast("string"), F.lit("1"))).alias("refers"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                some = batch.slice(i, 100).to_pydict()
                out = [gzip.compress(x + END, 6, mtime=0) for row in zip(*(some[c] for c in ("record_id", "url", "payload", "digest", "refers")), strict=True)
                       for x in records(*row, date, segment)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # The text writer writes a row's bytes as they are, and then its line end.
    (rows.mapInArrow(packed, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_records(segment)).mode("error").text(path))
    odd.unpersist()
    ids.unpersist()
    _renamed(pages.sparkSession, path)


def _renamed(spark: SparkSession, path: str) -> None:
    """The files' names end as archives' do. A rename each, by the file system that Spark wrote to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        if (name := f.getPath().getName()).endswith(".txt"):
            fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(at, name.removesuffix(".txt") + ".warc.gz"))


PARSED = (
    "record_id string, type string, uri string, refers_to string, payload_digest string, origin string, segment int, "
    "total long, block binary, error string"
)


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file, in time that grows with its length: after a member, no more than a piece is given back."""
    out, at, rest = [], 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise EOFError("the file ends within a member")
            piece = rest[at : at + 2048]
            out.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        while at < len(data) and data[at] == 0:  # padding
            at += 1
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple]:
    """A file's records, found by their Content-Length: a payload may hold what looks like a record."""
    if data[:2] == b"\x1f\x8b":
        data = gunzip(data)
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        f = dict(map(_field, lines[1:]))
        at = stop + 4 + int(f["content-length"])
        if at > len(data):
            raise ValueError("the last record is cut off")
        bare = lambda k: f[k].strip("<>") if k in f else None  # noqa: E731, B023
        number = lambda k: int(f[k]) if k in f else None  # noqa: E731, B023
        yield (bare("warc-record-id"), f["warc-type"], f.get("warc-target-uri"), bare("warc-refers-to"), f.get("warc-payload-digest"),
               bare("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), data[stop + 4 : at])


def assembled(records: Iterator[tuple], whole: bool) -> Iterator[tuple]:
    """Records of a file: with `whole`, those without segments and those whose segments are all in the file, put together;
    without, the segments that are left. What is broken comes with the former, as a row of nothing but the error."""
    parts: dict[str, list[tuple]] = {}
    try:
        for r in records:
            if r[6] is not None:
                parts.setdefault(r[5] or r[0], []).append(r)
            elif whole:
                yield (*r, None)
    except (ValueError, KeyError, EOFError, OSError, zlib.error) as e:
        if whole:
            yield (*[None] * 9, repr(e))
    for origin, segments in parts.items():
        segments.sort(key=lambda r: r[6])
        block = b"".join(r[8] for r in segments)
        complete = [r[6] for r in segments] == list(range(1, len(segments) + 1)) and segments[-1][7] == len(block)
        if complete and whole:
            yield (origin, *segments[0][1:5], None, None, None, block, None)
        elif not complete and not whole:
            yield from ((*r, None) for r in segments)


def _batches(rows: Iterator[tuple], schema: str, size: int) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=list(names))


def _assembled(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple]:
    for batch in batches:
        for path, data in zip(*batch.columns, strict=True):
            for row in assembled(parse(data.as_py()), whole):
                yield row if row[-1] is None else (*row[:-1], f"{path.as_py()}: {row[-1]}")


READ = "record_id string, type string, uri string, refers_to string, payload_digest string, stated_bytes long, payload binary, error string"


def decoded(record_id, kind, uri, refers_to, payload_digest, block: bytes, error: str | None) -> tuple:
    """Of a record whose segments are in order: the payload, checked, or what is wrong with it."""
    payload, stated = None, None
    if error is None:
        try:
            payload, stated = payload_of(block)
            if kind == "revisit":
                payload = None
            elif stated not in (None, len(payload)):
                payload, error = None, "the payload's length is another"
            elif payload_digest not in (None, "sha256:" + hashlib.sha256(payload).hexdigest()):
                payload, error = None, "the payload's digest is another"
        except ValueError as e:
            payload, error = None, str(e)
    return record_id, kind, uri, refers_to, payload_digest, stated, payload, error


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files' whole records, decoded by the worker that parses them: with one of its own for it, executors hold twice the workers."""
    return _batches((decoded(*r[:5], *r[8:]) for r in _assembled(batches, True)), READ, 100)


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of records that are not whole in their file."""
    return _batches(_assembled(batches, False), PARSED, 200)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches((decoded(*r.values()) for b in batches for i in range(0, b.num_rows, 100) for r in b.slice(i, 100).to_pylist()), READ, 100)


def read(spark: SparkSession, path: str) -> DataFrame:
    """An archive's response and revisit records, one row each, with the decoded payload or an error.

    Whole records are decoded where they are read, and so are those whose segments are all in one file. Other segments meet by their origin's id, are
    put in order and joined if they are numbered 1, 2, ... n and add up to the total that the last one states. A group is one
    record, so no larger than its payload. A record whose segments are missing, repeated or of the wrong total,
    whose chunks are broken, or whose length or digest differs, comes back with an error and a null payload. A file that is no
    archive from some place on gives its records up to there, and a row with nothing but the error, which names the file.

    Nulls: what a record does not state is null. Repeated records come back each if they are whole; segments of records
    of one id are one record's, and so repeated. A file is read as a whole, by one task, so files should be of bounded size, as those that
    write() makes are; a very long record is one row. An archive without files or records gives no rows.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(schema).load(path).select("path", "content")
    head = ["record_id", "type", "uri", "refers_to", "payload_digest"]
    one = F.struct("segment", "total", "block", *(F.when(F.col("segment") == 1, F.col(c)).alias(c) for c in head[1:]))
    parts = files.mapInArrow(_left, PARSED).groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        F.array_sort(F.collect_list(one)).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    numbers = F.transform("s", lambda x: x["segment"])
    wrong = (
        F.when(numbers != F.sequence(F.lit(1), F.size("s")), "segments are missing or repeated")
        .when(F.coalesce(F.element_at("s", -1)["total"] != total, F.lit(True)), "the segments' total length is wrong")
    )
    joined = parts.select(
        "record_id", *(F.get("s", F.lit(0))[c].alias(c) for c in head[1:]),
        F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["block"])).alias("block"), wrong.alias("error"))
    return files.mapInArrow(_whole, READ).unionByName(joined.mapInArrow(_joined, READ))


def summary(archive: DataFrame) -> DataFrame:
    """Per record written by write(): page_id, the payload's size and digest, the type and whom it refers to."""
    page = lambda c: F.try_to_number(F.split_part(c, F.lit(":"), F.lit(3)), F.lit("S9999999999999999999")).cast("long")
    response = F.col("type") == "response"
    return archive.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("stated_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"), "error")
