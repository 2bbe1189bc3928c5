import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import quality

TABLES = quality._tables()


def plain(text):
    """The base counts, word by word."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    spans = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if spans[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é  \n\t\x0b#|<&中", max_size=120))
def test_base_counts(text):
    assert quality.measure(text, "en", TABLES)[:5] == plain(text)



@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, " ".join(f"w{(7 * i + k) % 97}x the {k} of" for k in range(60)), "en") for i in range(40)]
    rows += [(100, " ".join(f"a{k}###$$$ %%{k}&&&" for k in range(80)), "en"), (101, None, None), (102, "", "en"),
             (103, "same words here now again " * 30, "en"), (None, rows[0][1], None), (0, rows[0][1], "en"),
             (105, "x" * 300_000 + " " + rows[1][1], "en")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, lang string, n_words int, kept string")
    return rows, quality.judge(df).toPandas()


def test_every_row_comes_back(judged):
    rows, out = judged
    assert len(out) == len(rows)
    want = sorted(plain(t) for _, t, _ in rows)
    got = out[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]
    assert sorted(map(tuple, got.itertuples(index=False))) == want


def test_verdicts(judged):
    _, out = judged
    by = out.drop_duplicates("doc_id").set_index("doc_id")
    assert by.loc[range(40), "kept"].all()
    assert not by.loc[100, "kept"] and not by.loc[100, "base_failed"]
    for k in (101, 102, 103):
        assert by.loc[k, "base_failed"] and not by.loc[k, "kept"]


def test_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.5, 0.5]), ([1.0, 0.0, 0.0], [0.0, 0.0, 1.0]), ([1.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality._distance("p", "q")).collect()]
    assert got == pytest.approx([math.sqrt(0.5), 1.0, 0.0])


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
