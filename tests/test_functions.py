import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import bits, hyperplanes
from kindred.functions import vectors as V
from kindred.operators import signatures


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def words(*xs):
    return F.array(*(F.lit(x).cast("long") for x in xs))


def test_cosine(spark):
    got = one(spark, right=V.cosine(vec(1, 0), vec(0, 1)), against=V.cosine(vec(1, 0), vec(-1, 0)), same=V.cosine(vec(1, 0), vec(1, 0)),
              zero=V.cosine(vec(0, 0), vec(1, 0)), tiny=V.cosine(vec(1e-200, 0), vec(1e-200, 0)), other=V.cosine(vec(1, 0), vec(1)))
    assert (got.right, got.against, got.same, got.zero, got.other, got.tiny) == (0.0, -1.0, 1.0, 0.0, None, 1.0)
    a, b, c = vec(1, 2, 3), vec(1, 2, 4), vec(7, 7, 9)
    got = one(spark, ab=V.cosine(a, b), ac=V.cosine(a, c), bc=V.cosine(b, c))
    assert got.ab >= got.ac >= got.bc


@given(st.lists(st.tuples(*[st.floats(-5, 5)] * 4), min_size=1, max_size=6))
def test_tiles_equal_scalars(rows):
    x = np.array(rows)
    for k, a in enumerate(x):
        for j, b in enumerate(x):
            na, nb = math.hypot(*a), math.hypot(*b)  # squares of tiny numbers are no doubles
            want = 0.0 if na == 0 or nb == 0 else (a / na) @ (b / nb)
            assert V.COSINE.tile(x, x)[k, j] == pytest.approx(want, abs=1e-9)
            assert V.NEGATIVE_DISTANCE.tile(x, x)[k, j] == pytest.approx(-math.dist(a, b), abs=1e-6)


def test_bits_of_signs(spark):
    got = one(spark, a=bits.to_text(bits.from_signs(vec(-1, 1, 5))), b=bits.to_text(bits.from_signs(F.array(F.lit(0.0), F.lit(-0.0), F.lit(float("nan")), F.lit(1.0)))))
    assert (got.a, got.b) == ("1,2", "3")


def test_bit_functions(spark):
    got = one(spark, h=bits.hamming(words(1), words(4)), far=bits.hamming(words(1), words(1, -1)), n=bits.cardinality(words(-1, 3)), eq=bits.equal(words(2), words(2)),
              ne=bits.equal(words(2), words(0)), text=bits.to_text(words(10)), none=bits.to_text(words(0)), top=bits.to_text(words(-(2**63), 1)),
              nxt=bits.next_set_bit(words(0, 1), 3), no=bits.next_set_bit(words(7), 3), cap=bits.capacity(words(1, 2, 3)), wide=bits.and_not(words(7), words(1, 5)),
              got=bits.bit_get(words(0, 2), F.lit(65)), beyond=bits.bit_get(words(0), F.lit(65)), put=bits.with_bit(words(0, 0), F.lit(127)), off=bits.without_bit(words(-1), F.lit(63)),
              flip=bits.flip_bit(words(5), F.lit(0)), fill=bits.set_until(words(0, 0), F.lit(65)), fill63=bits.set_until(words(0), F.lit(63)), empty=bits.clear_until(words(-1, -1), F.lit(64)),
              cos=bits.hamming_to_cosine(F.lit(2), 4))
    assert (got.h, got.far, got.n, got.eq, got.ne, got.text, got.none, got.top) == (2, 64, 66, True, False, "1,3", "", "63,64")
    assert (got.nxt, got.no, got.cap, got.wide, got.got, got.beyond) == (64, -1, 192, [6], 1, None)
    assert (got.put, got.off, got.flip, got.fill, got.fill63, got.empty) == ([0, -(2**63)], [2**63 - 1], [4], [-1, 1], [2**63 - 1], [0, -1])
    assert got.cos == pytest.approx(0.0)


def test_planes_and_permutations():
    assert hyperplanes.planes(10, 5, 1).shape == (10, 5)
    assert sorted(hyperplanes.permutation(10, 3)) == list(range(10))
    assert hyperplanes.permuted(np.array([True, True, False]), np.array([2, 1, 0])).tolist() == [False, True, True]
    r, p, x = hyperplanes.planes(6, 12, 4), hyperplanes.permutation(12, 5), np.random.default_rng(1).standard_normal((9, 6))
    assert (signatures.positive(x, hyperplanes.permuted(r, p)) == hyperplanes.permuted(signatures.positive(x, r), p)).all()


def test_projection_gives_the_bits_of_both_sides(spark):
    r = np.array([[1.0, -1.0], [-1.0, 1.0], [1.0, -1.0]])
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (10, [0.0, 1.0, 0.0])], "id long, vector array<double>")
    got = {x.id: (x.words, x.bits) for x in signatures.with_signature(df, r).select("id", F.col("sig_words").alias("words"), signatures.bit_string(2).alias("bits")).collect()}
    assert got == {0: ([1], "10"), 10: ([2], "01")}


@given(st.lists(st.lists(st.booleans(), min_size=70, max_size=70), min_size=2, max_size=2))
def test_key_order_is_the_order_of_bits(rows):
    a, b = (signatures._keys(np.array([x])).to_pylist()[0] for x in rows)
    assert (a < b) == (rows[0] < rows[1]) and (a == b) == (rows[0] == rows[1])


def test_hamming_stands_for_cosine():
    x = np.random.default_rng(9).standard_normal((3, 150))
    s = signatures.positive(x, hyperplanes.planes(150, 5000, 2))
    for a in range(3):
        for b in range(3):
            cos = x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b])
            assert math.cos(math.pi * (s[a] != s[b]).mean()) == pytest.approx(cos, abs=0.1)


def test_tiny_and_huge_vectors(spark):
    got = one(spark, tiny=V.l2_norm(vec(3e-200, 4e-200)), huge=V.l2_norm(vec(3e200, 4e200)), zero=V.l2_norm(vec(0, 0)), both=V.cosine(vec(1e-200, 1e-200), vec(1e200, 0)))
    assert math.isclose(got.tiny, 5e-200) and math.isclose(got.huge, 5e200) and got.zero == 0.0 and math.isclose(got.both, math.sqrt(0.5))
    s = V.COSINE.tile(np.array([[1e-200, 1e-200], [0.0, 0.0]]), np.array([[1e200, 0.0]]))
    assert math.isclose(s[0, 0], math.sqrt(0.5)) and s[1, 0] == 0.0


def test_near_equal_vectors_keep_their_distance():
    a = np.array([[1e6, 1.0, 2.0]])
    b = a + np.array([[1e-4, 0.0, 0.0]])
    assert math.isclose(V.NEGATIVE_DISTANCE.tile(a, b)[0, 0], -float(abs(b - a)[0, 0]), rel_tol=1e-9) and V.NEGATIVE_DISTANCE.tile(a, a)[0, 0] == 0.0
