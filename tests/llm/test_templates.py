import math
import random
import re
from collections import Counter, defaultdict

import pytest

from kindred.llm import templates as T


def mask(line):
    return " ".join("<*>" if re.search("[0-9@]", w) else w for w in re.findall("[^\x20\x09-\x0d]+", line))


def worth(m):
    return max(len(m.split(" ")), len(m) // T.CHARS)


def need(n):
    return next((d for below, d in T.DOCS if n < below), T.DOCS_LONGEST)


def plain(rows):
    """What stays of each text, line by line."""
    docs, first = Counter(), {}
    whole = defaultdict(set)
    for i, t in rows:
        if t is not None:
            whole[i] |= {mask(x) for x in t.split("\n")} - {""}
    for i, ms in whole.items():
        for m in ms:
            docs[m] += 1
            if i is not None:
                first[m] = min(i, first.get(m, i))
    leaves = defaultdict(list)
    for m in docs:
        w = m.split(" ")
        if len(w) >= T.LEADING + T.LEAST_ALIKE:
            leaves[len(w), 0, *w[: T.LEADING]].append(m)
            leaves[len(w), 1, *w[-T.LEADING :]].append(m)
    gone: dict = {m: first[m] for m in docs if docs[m] >= need(worth(m)) and m in first}
    for (n, tail, *_), ms in leaves.items():
        least = max(need(n), T.DOCS_TEMPLATE)
        if len(ms) < 2 or sum(docs[m] for m in ms) < least:
            continue
        own = {m: m.split(" ")[: -T.LEADING] if tail else m.split(" ")[T.LEADING :] for m in ms if m in first}
        support = Counter()
        for m, w in own.items():
            for at in enumerate(w):
                support[at] += docs[m]
        groups = defaultdict(list)
        for m, w in own.items():
            s = [support[at] for at in enumerate(w)]
            level = sorted(s, reverse=True)[max(math.ceil(T.ALIKE * 10 * len(w) / 10), T.LEAST_ALIKE) - 1]
            if level >= least:
                groups[tuple(x if 2 * k >= level and k >= T.DOCS_TEMPLATE else None for x, k in zip(w, s, strict=True))].append(m)
        for found in groups.values():
            most = Counter()
            for m in found:
                most[first[m]] = max(most[first[m]], docs[m])
            if sum(most.values()) >= least:
                for m in found:
                    gone[m] = min(gone.get(m, first[m]), *most)
    out = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        left = [x for x in lines if i is None or mask(x) not in gone or gone[mask(x)] == i]
        out.append((i, None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [T.FILTER, T.PART])
def test_equals_line_by_line(spark, monkeypatch, bits):
    monkeypatch.setattr(T, "FILTER", bits)
    rng = random.Random(2)
    word = lambda: f"{rng.choice('abcdefghij')}{rng.choice('klmnop')}"
    common = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9, 60]))) for _ in range(12)]
    rows = []
    for k in range(150):
        lines = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(0, 6))]
        lines += rng.sample(common, rng.randrange(0, 3))
        if k % 3 == 0:
            lines.append(f"Posted on {k}-01 by user {word()} in the news section")
        if k % 4 == 0:
            lines.append(f"Read the next page  {k} of\t{k + 1}")
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    rows += [(None, common[3]), (900, None), (901, ""), (902, "\n\n"), (903, "z" * 200_000), (904, "z1" * 100_000 + " y x w v u t s r"), (7, rows[7][1]),
             (8, "another text of id 8\n" + common[5] + "\n" + common[6])]
    rows += [(1000 + k, f"{word()} and {word()} went to the market of {word()} yesterday\n漢字かな交じり文の長い繰り返し行です。これは短くない。\nMore") for k in range(20)]
    rows += [(1100 + k, f"x{k}\n" + " ".join(["long"] * 30 + ["line"] * 30) + f"\nThis text was written by {word()}{k} for the paper here") for k in range(2)]
    df = spark.createDataFrame([(*r, "leaf?", 5) for r in rows], "doc_id long, text string, leaf string, place int").repartition(4)
    out = T.dedup(df)
    assert out.columns == ["doc_id", "text", "leaf", "place", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    assert got == plain(rows)
    assert sum(r[3] for r in got) > 100


def test_empty(spark):
    assert T.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


NAMES = [f"{a}{b}" for a in ("Al", "Be", "Cu", "De", "Em", "Fo", "Gu") for b in ("ra", "na", "to", "ki", "mo", "du", "so", "pe", "vi", "xa")]


def planted(lines):
    """Documents of a few lines of their own and one of these, and what of it is dropped."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    return [(k, "\n".join([" ".join(word() for _ in range(9)), x, " ".join(word() for _ in range(12))])) for k, x in enumerate(lines)]


@pytest.mark.parametrize(("kinds", "each"), [
    (["This article was written by {} for the evening news"], 10),
    (["This article was written by {} for the evening news", "This article was last edited in {} by our staff"], 10),
    (["This article was written by {} for the evening news", "This article was last edited in {} by our staff", "This article was kindly paid for by {} of town"], 20),
    (["{} joined our mailing list last week and so can you"], 20),
    (["Photo taken by {} near the old harbour of {} at noon"], 20),
])
def test_planted_templates(spark, kinds, each):
    """All lines of each template go but the first, also where templates share a leaf, or begin with a field."""
    lines = [x.format(NAMES[(7 * k + j) % 70], NAMES[(11 * k + 3) % 70]) for j, x in enumerate(kinds) for k in range(each)]
    others = [f"This article was {' '.join(random.Random(k).sample(NAMES, 6))}" for k in range(5)]
    rows = planted([*lines, *others])
    got = {r.doc_id: r.n_dropped for r in T.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(got[k] for k in range(len(lines))) >= 0.9 * len(lines) - len(kinds)
    assert all(got[k] == 0 for k in range(len(lines), len(rows)))
    assert all(got[k * each] == 0 for k in range(len(kinds)))


def test_list_within_one_document(spark):
    """Lines of one pattern in one document, and one elsewhere, are no recurring template."""
    rows = [(1, "\n".join(f"The capital of {x} is the town of {y}" for x, y in zip(NAMES[:12], NAMES[20:32], strict=True))), (2, "The capital of Nowhere is the town of Nothing")]
    assert [r.n_dropped for r in T.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0]


def test_long_line_in_two_documents(spark):
    long = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, f"a b c\n{long}"), (2, f"{long}\nd e f"), (3, "g h i")]
    assert {r.doc_id: r.n_dropped for r in T.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 0, 2: 1, 3: 0}
