import random

import pytest

from kindred.llm import chat


def plain(rows):
    convs: dict = {}
    for k, (c, t, r, x) in enumerate(rows):
        convs.setdefault((c is None, k if c is None else c), []).append((t, r, x))
    low = lambda v: (v is not None, v)
    said = {c: [(r, x) for _, r, x in sorted(ts, key=lambda v: tuple(map(low, v)))] for c, ts in convs.items()}
    out = []
    for c, s in said.items():
        equal = [k for k, o in said.items() if o == s]
        if c == min(equal) and not any(len(o) > len(s) and o[: len(s)] == s for o in said.values()):
            out.append((None if c[0] else c[1], len(s), len(equal), "".join(f"<|im_start|>{'user' if r is None else r}\n{x or ''}<|im_end|>\n" for r, x in s)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [512, 2])
def test_keeps_the_maximal_ones(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    rng = random.Random(4)
    rows, logs = [], [[(("user", "assistant")[k % 2], rng.choice(["hi", "yes", "no", "ü"])) for k in range(rng.randrange(1, 9))] for _ in range(25)]
    for c in range(120):
        log = rng.choice(logs)
        rows += [(c, t, r, x) for t, (r, x) in enumerate(log[: rng.randrange(1, len(log) + 1)])]
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", "so"), (None, 7, "assistant", "so"), (500, None, None, None), (500, 3, "user", ""), (501, None, None, ""), (502, 1, "user", "a"),
             (502, 1, "user", "a"), (503, 1, "user", "b"), (503, 1, "system", "b"), (504, 7, "user", "x" * 300_000), (505, 9, "user", "x" * 300_000), (506, -3, "user", "m")]
    rows += [(600, t, "user", str(t)) for t in range(1500)] + [(601, t, "user", str(t)) for t in range(1100)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, h1 string").repartition(4)
    got = sorted((tuple(r) for r in chat.collapse(df).collect()), key=str)
    assert got == plain(rows)


def test_empty(spark):
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
