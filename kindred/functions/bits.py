"""Bit vectors as ARRAY<BIGINT> columns: bit k is bit k mod 64 of word k div 64.

A vector of another width is read as if padded with zero words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import _col


def _zip(a, b, f) -> Column:
    zero = F.lit(0).cast("long")
    return F.zip_with(_col(a), _col(b), lambda x, y: f(F.coalesce(x, zero), F.coalesce(y, zero)))


def xor(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseXOR(y))


def and_(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseAND(y))


def or_(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x.bitwiseOR(y))


def and_not(a: Column | str, b: Column | str) -> Column:
    """The bits of a that b lacks; as wide as a."""
    return F.slice(_zip(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y))), 1, F.size(_col(a)))


def cardinality(a: Column | str) -> Column:
    return F.aggregate(F.transform(_col(a), lambda x: F.bit_count(x).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming(a: Column | str, b: Column | str) -> Column:
    return cardinality(xor(a, b))


def equal(a: Column | str, b: Column | str) -> Column:
    return hamming(a, b) == 0


def hamming_to_cosine(h: Column | str, d: int) -> Column:
    """The cosine whose random-hyperplane signatures of d bits differ in h of them on average."""
    return F.cos(F.pi() * _col(h) / d)


def capacity(a: Column | str) -> Column:
    return (F.size(_col(a)) * 64).cast("long")


def bit_get(a: Column | str, k: Column) -> Column:
    """0 or 1; null beyond the capacity."""
    return F.call_function("getbit", F.get(_col(a), (k / 64).cast("int")), (k % 64).cast("int")).cast("int")


def set_bits(a: Column | str) -> Column:
    """The set bits' numbers, ascending."""
    words = F.transform(_col(a), lambda w, i: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(F.call_function("getbit", w, k) == 1, i * 64 + k)), lambda k: k.isNotNull()))
    return F.flatten(words)


def next_set_bit(a: Column | str, start: Column | int) -> Column:
    """The first set bit from `start` on, or -1."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.coalesce(F.array_min(F.filter(set_bits(a), lambda k: k >= start)), F.lit(-1))


def to_text(a: Column | str) -> Column:
    """Like "1,3"; empty for no bits."""
    return F.array_join(set_bits(a), ",")


def _one(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (k % 64).cast("int"))


def _at(a, k: Column, f) -> Column:
    return F.transform(_col(a), lambda w, i: F.when(i == (k / 64).cast("int"), f(w, _one(k))).otherwise(w))


def with_bit(a: Column | str, k: Column) -> Column:
    return _at(a, k, lambda w, b: w.bitwiseOR(b))


def without_bit(a: Column | str, k: Column) -> Column:
    return _at(a, k, lambda w, b: w.bitwiseAND(F.bitwise_not(b)))


def flip_bit(a: Column | str, k: Column) -> Column:
    return _at(a, k, lambda w, b: w.bitwiseXOR(b))


def from_signs(v: Column | str) -> Column:
    """Bit k is set if v[k] > 0; neither zero nor NaN is."""
    v = _col(v)
    sign = lambda x: F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))
    words = F.sequence(F.lit(0), F.greatest((F.size(v) - 1) / 64, F.lit(0)).cast("int"))
    return F.transform(words, lambda i: F.aggregate(
        F.slice(v, i * 64 + 1, 64), F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("k")),
        lambda s, x: F.struct(F.when(sign(x), s["w"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s["k"]))).otherwise(s["w"]).alias("w"), (s["k"] + 1).alias("k")),
        lambda s: s["w"]))


def _mask(a, until: Column, f) -> Column:
    """Applies f(word, mask of the word's bits below `until`)."""
    def mask(i):
        n = F.least(F.greatest(until - i * 64, F.lit(0)), F.lit(64))
        return F.when(n == 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1)

    return F.transform(_col(a), lambda w, i: f(w, F.when(until - i * 64 == 63, F.lit(2**63 - 1)).otherwise(mask(i))))


def set_until(a: Column | str, until: Column) -> Column:
    return _mask(a, until, lambda w, m: w.bitwiseOR(m))


def clear_until(a: Column | str, until: Column) -> Column:
    return _mask(a, until, lambda w, m: w.bitwiseAND(F.bitwise_not(m)))


def clear(a: Column | str) -> Column:
    return F.transform(_col(a), lambda w: F.lit(0).cast("long"))
