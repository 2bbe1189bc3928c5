"""Quality rules: word counts, and how far a document's histograms are from its language's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .words import hashes, windows

# Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on are this from or at an not have but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus ce il ne se avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
#: Where no language is known all of them share a reference over the words of all lists.
REST = "rest"
LISTS = {**COMMON, REST: sorted({w for ws in COMMON.values() for w in ws})}

# The character classes by byte. UTF-8's second and later bytes are skipped.
CLASSES = ("lower", "upper", "digit", "space", "line end", "punctuation", "symbol", "accented", "other")
_SYMBOLS = b"#*$%&|<>=+@^~`/\\_{}[]!?"
_CLASS_OF = bytes(
    255 if 0x80 <= b < 0xC0 else 7 if b in (0xC3, 0xC5) else 8 if b >= 0xC0 or b < 9 or 13 < b < 32 or b == 127
    else 4 if b == 10 else 3 if b <= 32 else 2 if chr(b).isdigit() else 0 if chr(b).islower() else 1 if chr(b).isupper()
    else 6 if b in _SYMBOLS else 5
    for b in range(256)
)
_SPACES, _SIGNS = b" \t\n\v\f\r", b"#*$%&|<>"

#: A histogram is judged from so many words on; below, chance alone moves it too far.
MIN_WORDS_CHARS, MIN_WORDS_WORDS = 20, 60
#: A document is rejected beyond the distance a + b / sqrt(n_words): chance moves a histogram by 1 / sqrt(n_words).
MAX_CHARS, MAX_WORDS = (0.26, 0.5), (0.21, 1.0)

PROFILE = (
    "doc_id {}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "chars array<int>, words array<int>"
)


def _variants(word: str) -> set[bytes]:
    return {(w + end).encode() for w in (word, word.capitalize()) for end in ("", ".", ",", ";", ":", "!", "?")}


def _tables() -> dict:
    """For each language the sorted hashes of its common words' spellings, and the bin of each."""
    out = {}
    for lang, words in LISTS.items():
        pairs = sorted((int(h), k) for k, w in enumerate(words) for h in hashes(sorted(_variants(w))))
        out[lang] = (np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs]), len(words))
    return out


def measure(text: str | None, lang: str, tables: dict) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    solid = raw.translate(None, _SPACES)
    points = len(solid) - int(np.count_nonzero((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80))
    signs = len(raw) - len(raw.translate(None, _SIGNS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ids = hashes(words)
    repeated = 0
    if len(words) >= 6:
        _, where, counts = np.unique(windows(ids, 5), return_inverse=True, return_counts=True)
        found = np.flatnonzero(counts[where] > 1)
        if len(found):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, found, 1)
            np.add.at(edge, found + 5, -1)
            repeated = int(np.count_nonzero(np.cumsum(edge)))
    chars = np.bincount(np.frombuffer(raw.translate(_CLASS_OF), np.uint8), minlength=256)[: len(CLASSES)]
    known, bins, other = tables[lang]
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    hist = np.bincount(np.where(known[at] == ids, bins[at], other), minlength=other + 1)
    return len(words), points, signs, len(lines) - len(set(lines)), repeated, chars.tolist(), hist.tolist()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _tables()
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * 2
    for batch in batches:
        ids, texts, langs = batch.columns
        for i in range(0, len(ids), 500):
            kept = [x if x in COMMON else REST for x in langs[i : i + 500].to_pylist()]
            rows = [measure(t, x, tables) for t, x in zip(texts[i : i + 500].to_pylist(), kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids[i : i + 500], pa.array(kept, pa.string()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"],
            )


def _shares(counts: str):
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def _distance(p: str, q: str):
    """Jensen-Shannon distance with base 2: 0 for equal distributions, 1 for disjoint ones."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_chars: tuple[float, float] = MAX_CHARS, max_words: tuple[float, float] = MAX_WORDS, id_type: str = "long") -> DataFrame:
    """A row per document: doc_id, the base counts, base_failed, the two distances and kept.

    References: for each language with a list of common words, the mean histogram of all its documents that
    pass the base rules and are long enough, each document weighing the same; all other documents share one
    reference. So there are five at most, whatever the table holds, and they are broadcast. The texts are read
    once; the references come from the table of histograms, which is kept.

    Nulls: a null text has no words, so base_failed; a null or unknown language uses the shared reference; ids
    are carried as they are. Texts under the guards have a null distance and are judged by the base rules
    alone. Repeated rows are judged alike, whatever their ids. A very long text is one row in memory, with a few numbers a word. Other columns are not read. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     F.col(lang_col).cast("string").alias("lang"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    seen = keep(docs.mapInArrow(_profile, PROFILE.format(id_type))).withColumns(
        {"base_failed": failed, "chars": _shares("chars"), "words": _shares("words")})
    fit = seen.where(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS_WORDS))

    def mean(col: str, n: int):
        return F.array(*(F.avg(F.get(col, F.lit(k))) for k in range(n)))

    longest = max(map(len, LISTS.values())) + 1
    refs = fit.groupBy("lang").agg(mean("chars", len(CLASSES)).alias("ref_chars"), mean("words", longest).alias("ref_words"))
    refs = refs.withColumn("ref_words", F.filter("ref_words", lambda x: x.isNotNull()))
    judged = seen.join(F.broadcast(refs), "lang", "left").withColumns({
        "chars_distance": F.when(F.col("n_words") >= MIN_WORDS_CHARS, _distance("chars", "ref_chars")),
        "words_distance": F.when(F.col("n_words") >= MIN_WORDS_WORDS, _distance("words", "ref_words")),
    })

    def beyond(col: str, limit: tuple[float, float]):
        return F.coalesce(F.col(col) > limit[0] + limit[1] / F.sqrt(F.greatest("n_words", F.lit(1))), F.lit(False))

    far = beyond("chars_distance", max_chars) | beyond("words_distance", max_words)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~far).alias("kept"), "chars_distance", "words_distance")
