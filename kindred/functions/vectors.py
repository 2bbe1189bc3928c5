"""Vector measures, each as a Column function and as a numpy kernel over tiles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Null if the lengths differ: zip_with pads the shorter side with nulls."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _largest(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))


def _scaled(a: Column | str) -> Column:
    """The vector over its largest element, so that squares of tiny or huge ones stay numbers; zero and infinite ones as they are."""
    one = F.transform(F.array(_col(a)), lambda v: F.transform(F.array(_largest(v)), lambda m: F.when((m > 0) & (m < float("inf")), F.transform(v, lambda x: x / m)).otherwise(v))[0])
    return F.when(_col(a).isNotNull(), one[0])


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def l2_norm(a: Column | str) -> Column:
    """Also of elements whose squares are no doubles."""
    a = _col(a)
    large = _largest(a)
    return F.when((large > 0) & (large < float("inf")), large * _norm(_scaled(a))).otherwise(_norm(a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; 0 if either vector is zero, null if the lengths differ."""
    both = F.array(F.struct(_scaled(a).alias("a"), _scaled(b).alias("b")))

    def of(x: Column) -> Column:
        na, nb, ab = _norm(x["a"]), _norm(x["b"]), dot(x["a"], x["b"])
        return F.when(ab.isNull(), F.lit(None)).when((na == 0) | (nb == 0), 0.0).otherwise(ab / na / nb)

    return F.transform(both, of)[0]


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


@dataclass(frozen=True)
class Similarity:
    """A measure that grows with closeness. `tile` maps (n, d) and (m, d) to (n, m); without it the joins use `column`.

    A matrix product may round equal pairs of rows unlike, by where they stand. `rows` maps (n, d) and (n, d) to (n), and gives equal rows
    equal values: where the best are chosen they are compared by it, so that copies tie."""

    column: Callable[[Column, Column], Column]
    tile: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    large = np.abs(x).max(axis=1, initial=0.0)
    fit = np.isfinite(large) & (large > 0)
    x = np.divide(x, large[:, None], out=x.astype(np.float64), where=fit[:, None])
    norm = np.sqrt((x * x).sum(1))
    return np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] != 0)


def _cosine_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return _units(a) @ _units(b).T


def _dot_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Added up feature by feature, as SQL does."""
    total = np.zeros(len(a))
    with np.errstate(invalid="ignore"):
        for k in range(a.shape[1]):
            total += a[:, k] * b[:, k]
    return total


def _cosine_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return _dot_rows(_units(a), _units(b))


def _distance_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By expanded squares, but for near-equal vectors, where those cancel: their differences are taken."""
    total = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    square = total - 2 * (a @ b.T)
    x, y = np.nonzero(square <= 1e-6 * total)
    for k in range(0, len(x), 4096):
        i, j = x[k : k + 4096], y[k : k + 4096]
        square[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return -np.sqrt(np.maximum(square, 0.0))


COSINE = Similarity(cosine, _cosine_tile, _cosine_rows)
DOT = Similarity(dot, lambda a, b: a @ b.T, _dot_rows)
NEGATIVE_DISTANCE = Similarity(lambda a, b: -euclidean(a, b), _distance_tile, lambda a, b: -np.sqrt(_dot_rows(a - b, a - b)))
