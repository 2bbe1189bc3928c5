"""Seeded random hyperplanes and permutations."""

from __future__ import annotations

import numpy as np


def planes(features: int, bits: int, seed: int) -> np.ndarray:
    """(features, bits) normal deviates, rounded to single precision, so that they can be written out as literals."""
    return np.random.default_rng(seed).standard_normal((features, bits)).astype(np.float32).astype(np.float64)


def permutation(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(n)


def permuted(bits: np.ndarray, perm: np.ndarray) -> np.ndarray:
    """Columns scattered: column perm[k] of the result is column k. The same for hyperplanes and for their bits."""
    out = np.empty_like(bits)
    out[..., perm] = bits
    return out


def literal(r: np.ndarray) -> str:
    """The hyperplanes as a SQL list of lists, plane by plane."""
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in plane) + "]" for plane in r.T) + "]"
