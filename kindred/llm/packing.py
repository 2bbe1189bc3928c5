"""Packing documents into windows of tokens, neighbours by BM25 together."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep
from .words import mixed

WINDOW = 1024
#: Every so many ids there is a seed: documents whose id it divides are the queries.
EVERY = 50
#: Documents per shard of the index, documents and seeds that are scored at once.
SHARD, BLOCK, SEEDS = 1 << 14, 4096, 512
#: The most frequent terms are scored by a matrix product, others by postings. Only speed hangs on it.
DENSE = 1024
#: Documents that a window looks ahead for one that fits whole.
LOOK = 64
K1, B = 1.2, 0.75
#: Longer runs of white space exceed what the faster library's pattern may go back over.
_LONG_SPACE = re.compile(r"\s{50000}")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, by a tokenizers file.

    With a ranks file, the same vocabulary for tiktoken, which gives the same ids several times faster; the tests
    hold the two against each other, over all letters too.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.fast = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or _LONG_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        return self.fast.encode_to_numpy(text, allowed_special="all").astype(self.dtype)


ENCODED = "doc_id long, size long, ids binary"


def _encoded(path: str, ranks: str | None):
    """Each document's ids, with the 0 that ends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks)
        for batch in batches:
            ids, texts = batch.columns
            for i in range(0, len(ids), 200):
                rows = [np.append(encoder.encode(t or ""), encoder.dtype.type(0)) for t in texts[i : i + 200].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids[i : i + 200], pa.array([len(x) for x in rows], pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())],
                    names=["doc_id", "size", "ids"])

    return run


def _counted(dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                has = np.unique(np.frombuffer(ids.as_py(), dtype)).astype(np.int64)
                if has[-1] >= len(counts):
                    counts = np.pad(counts, (0, int(has[-1]) + 1024 - len(counts)))
                counts[has] += 1
        token = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(counts[token], pa.int64())], names=["token", "n"])

    return run


def weighed(terms: np.ndarray, tf: np.ndarray, size, idf: np.ndarray, mean: float) -> np.ndarray:
    """The BM25 weights of a document's distinct terms, of so many times each."""
    return (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))).astype(np.float32)


class Asked:
    """Some seeds as queries: their distinct terms, and what each scores by itself."""

    def __init__(self, terms: list[np.ndarray], own: list[float], place: np.ndarray):
        self.n, self.own = len(terms), np.array(own, np.float32)
        term, where = np.concatenate(terms).astype(np.int64), np.repeat(np.arange(self.n), [len(t) for t in terms])
        column = place[term]
        many = column >= 0
        self.dense = np.zeros((int(place.max(initial=-1)) + 1, self.n), np.float32)
        self.dense[column[many], where[many]] = 1
        self.term, self.where = term[~many], where[~many]


class Postings:
    """The inverted index over some documents: the BM25 weights of all their terms, the most frequent ones as a matrix.

    `place` gives the column of each of those, and -1 for the others.
    """

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], place: np.ndarray):
        self.n, self.own = len(terms), np.array([w.sum() for w in weights], np.float32)
        term, weight = np.concatenate(terms).astype(np.int64), np.concatenate(weights)
        where = np.repeat(np.arange(self.n), [len(t) for t in terms])
        column = place[term]
        many = column >= 0
        self.dense = np.zeros((self.n, int(place.max(initial=-1)) + 1), np.float32)
        self.dense[where[many], column[many]] = weight[many]
        order = np.argsort(term[~many], kind="stable")
        self.where, self.weight = where[~many][order], weight[~many][order]
        self.starts = np.searchsorted(term[~many][order], np.arange(len(place) + 1))

    def scores(self, asked: Asked) -> np.ndarray:
        """BM25 of each document for each seed, by all terms that they share."""
        out = self.dense @ asked.dense
        lo, count = self.starts[asked.term], self.starts[asked.term + 1] - self.starts[asked.term]
        if total := int(count.sum()):
            at = np.arange(total) + np.repeat(lo - (np.cumsum(count) - count), count)
            flat = self.where[at] * asked.n + np.repeat(asked.where, count)
            out += np.bincount(flat, self.weight[at], out.size).reshape(out.shape)
        return out


class Shard:
    """A shard of the index. Each of its documents goes to the seed that retrieves it best.

    `best` is the BM25 score over what the two score by themselves: a long seed holds all terms, and would retrieve
    everything; a short one is held in full by many. Of equal seeds the first stays.
    """

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], place: np.ndarray, block: int | None = None):
        step = block or BLOCK
        self.parts = [Postings(terms[i : i + step], weights[i : i + step], place) for i in range(0, len(terms), step)]
        self.best, self.seed = np.zeros(len(terms), np.float32), np.full(len(terms), -1, np.int64)

    def ask(self, asked: Asked, seeds: np.ndarray) -> None:
        at = 0
        for part in self.parts:
            alike = part.scores(asked)
            alike /= part.own[:, None] + asked.own
            top = alike.argmax(axis=1)
            value = alike[np.arange(part.n), top]
            mine = slice(at, at + part.n)
            more = value > self.best[mine]
            self.seed[mine][more], self.best[mine][more] = seeds[top[more]], value[more]
            at += part.n


TERMS = "shard int, seed boolean, row long, size long, terms binary, tf binary"


def _dealt(dtype: np.dtype, shards: int, every: int):
    """Each document's terms for its shard of the index, and those of each seed for all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                out = []
                for row, doc, size, ids in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns), strict=True):
                    term, tf = np.unique(np.frombuffer(ids, dtype), return_counts=True)
                    is_seed = doc is not None and doc % every == 0
                    rest = (row, size, term.astype(dtype).tobytes(), np.minimum(tf, 65535).astype("<u2").tobytes())
                    out.append((int(mixed(np.array([row], np.uint64))[0] % np.uint64(shards)), False, *rest))
                    if is_seed:
                        out += [(k, True, *rest) for k in range(shards)]
                        if len(out) >= 5000:
                            yield _rows(out, TERMS)
                            out = []
                if out:
                    yield _rows(out, TERMS)

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


FOUND = "row long, size long, seed long, best float"


def _retrieved(held, dtype: np.dtype, seeds: int):
    """Per shard first its documents come, which are indexed, and then the seeds, which are asked block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean, place = held.value
        number = shard = None
        docs: list[tuple] = []
        queue: list[tuple] = []

        def ask() -> None:
            nonlocal shard
            if shard is None:
                shard = Shard([d[2] for d in docs], [d[3] for d in docs], place)
                docs[:] = [d[:2] for d in docs]
            if queue and docs:
                shard.ask(Asked([q[2] for q in queue], [float(q[3].sum()) for q in queue], place), np.array([q[0] for q in queue]))
            queue.clear()

        def out() -> pa.RecordBatch:
            ask()
            cols = [np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64), shard.seed, shard.best]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in FOUND.split(", ")])

        for batch in batches:
            for k, is_seed, row, size, terms, tf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != number:
                    if docs:
                        yield out()
                    number, shard = k, None
                    docs.clear()
                    queue.clear()
                term = np.frombuffer(terms, dtype)
                entry = (row, size, term, weighed(term, np.frombuffer(tf, "<u2").astype(np.float64), size, idf, mean))
                (queue if is_seed else docs).append(entry)
                if len(queue) == seeds:
                    ask()
        if docs:
            yield out()

    return run


def retrieved(docs: DataFrame, n: int, dtype: np.dtype, held, every: int = EVERY) -> DataFrame:
    """Of each document (row, size): the seed that retrieves it best, its row, or -1 if no seed shares a term, and how well.

    The index is sharded by documents; each shard answers all seeds, with all their terms, so nothing is lost between
    shards. A task holds a shard, of about SHARD documents whatever n is, and the seeds go by. They are one document in `every`,
    so this step's work is n * n / every, and what is shuffled n documents' terms and as many seeds' as there are shards.
    """
    shards = -(-n // SHARD)
    dealt = docs.select("row", "doc_id", "size", "ids").mapInArrow(_dealt(dtype, shards, every), TERMS)
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "seed", "row").mapInArrow(_retrieved(held, dtype, SEEDS), FOUND)


def filled(docs: Iterator[tuple[int, int, int]], window: int = WINDOW, look: int | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) from a stream of (document, start, length), best neighbours first.

    A window takes the first that waits, then again and again the first of `look` waiting ones that fits whole, and if none
    does, as much of the first as there is room for: it goes on in the next window. Only the last window can be short.
    """
    look = look or LOOK
    waiting: list[list[int]] = []
    docs = iter(docs)

    def ready() -> bool:
        while len(waiting) < look and (more := next(docs, None)) is not None:
            if more[2]:
                waiting.append(list(more))
        return bool(waiting)

    while ready():
        out, room, k = [], window, 0
        while room and ready():
            if out:
                k = next((i for i, w in enumerate(waiting) if w[2] <= room), 0)
            doc, start, left = waiting[k]
            length = min(left, room)
            out.append((doc, start, length))
            room -= length
            if length == left:
                del waiting[k]
            else:
                waiting[k][1:] = start + length, left - length
        yield out


PLAN = "row long, start long, length long, window long, offset long"


def _planned(rest: bool):
    """Fills the windows of a partition. What is left of a short one at its end waits under window -1, but in the last step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (1 << 62) if rest else TaskContext.get().partitionId() << 32
        stream = (r for b in batches for i in range(0, b.num_rows, 5000) for r in zip(*(c.to_pylist() for c in b.slice(i, 5000).columns), strict=True))
        made: list[tuple] = []
        for k, pieces in enumerate(filled(stream)):
            short = not rest and sum(p[2] for p in pieces) < WINDOW
            offset = 0
            for row, start, length in pieces:
                made.append((row, start, length, -1 if short else first + k, offset))
                offset += length
            if len(made) >= 10_000:
                yield _rows(made, PLAN)
                made = []
        if made:
            yield _rows(made, PLAN)

    return run


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _summed(dtype: np.dtype):
    """A row per piece, with the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKED.split(", ")]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for doc, ids, pieces in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns), strict=True):
                    ids = np.frombuffer(ids, dtype)
                    rows += [(doc, p["start"], p["length"], _crc(ids[p["start"] : p["start"] + p["length"]]), len(ids), p["window"], p["offset"]) for p in pieces]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def corpus(docs: DataFrame, id_col: str, text_col: str, path: str, ranks: str | None):
    """The encoded documents (row, doc_id, size, ids), their number, the ids' type, and the broadcast idf, mean length and dense terms."""
    dtype = Encoder(path).dtype
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = keep(docs.mapInArrow(_encoded(path, ranks), ENCODED).withColumn("row", F.monotonically_increasing_id()))
    size = encoded.agg(F.count("*").alias("n"), F.coalesce(F.avg("size"), F.lit(1.0)).alias("mean")).first()
    counts = encoded.select("ids").mapInArrow(_counted(dtype), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 + max((r.token for r in counts), default=0), np.int64)
    for r in counts:
        df[r.token] = r.n
    place = np.full(len(df), -1)
    dense = np.argsort(-df, kind="stable")[:DENSE]
    place[dense[df[dense] > 0]] = np.arange(np.count_nonzero(df[dense]))
    return encoded, size.n, dtype, docs.sparkSession.sparkContext.broadcast((np.log1p((size.n - df + 0.5) / (df + 0.5)), float(size.mean), place))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks: str | None = None, every: int = EVERY) -> DataFrame:
    """Where each document's ids go: a row per piece, with the sequence and the offset in it.

    1. One pass encodes every text; an id 0 ends each document. The result is kept.
    2. Document frequencies and the mean length, of whole documents; there are as many terms as the vocabulary has ids,
       so they are collected and broadcast.
    3. The seeds, documents whose id `every` divides, are asked of a sharded index of all whole documents, with all their
       terms. A document is a neighbour of the one seed that retrieves it best, so it is unused by any other (see Shard).
    4. Documents are sorted by seed, and by how well it retrieves them. Along this order windows are filled (see filled),
       in parts of it: a seed with very many neighbours is cut too. The short windows at the parts' ends, one of each,
       are put together by one task.
    5. The pieces meet their ids again for the checksums.

    Nulls: a null text is the id 0 alone; null ids are carried, and are no seeds. Ties: of seeds that retrieve a document equally well
    the first row's counts, documents that a seed retrieves equally well go by row. Repeated rows, and different texts of one id, are
    packed each. A very long text is cut into as many windows as it fills. Without any seed the documents are packed as they come. Other columns are
    not read. An empty table gives no rows.
    """
    if path is None:
        path, ranks = tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken")
    encoded, n, dtype, held = corpus(docs, id_col, text_col, path, ranks)
    if not n:
        return docs.sparkSession.createDataFrame([], PACKED)
    found = cut(retrieved(encoded, n, dtype, held, every))
    order = ["seed", F.desc("best"), "row"]
    stream = found.repartitionByRange(*order).sortWithinPartitions(*order).select("row", F.lit(0).cast("long").alias("start"), "size")
    plan = cut(stream.mapInArrow(_planned(False), PLAN))
    ends = plan.where("window < 0").select("row", "start", "length").repartition(1).sortWithinPartitions("row", "start")
    plan = plan.where("window >= 0").unionByName(ends.mapInArrow(_planned(True), PLAN))
    pieces = plan.groupBy("row").agg(F.collect_list(F.struct("start", "length", "window", "offset")).alias("pieces"))
    return encoded.join(pieces, "row").select("doc_id", "ids", "pieces").mapInArrow(_summed(dtype), PACKED)
