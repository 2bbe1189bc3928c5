"""Words and word windows as 64-bit hashes, for the Arrow kernels."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Odd multipliers that make a window's hash depend on the order of its words.
STEPS = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads sums of products over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` words, none if there are fewer words."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += ids[k : k + n] * STEPS[k]
    return mixed(total)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted set of a text's shingles, A-Z lower-cased; of fewer words, the whole sequence as one.

    bytes.split() cuts at the ASCII white space, and bytes.lower() changes A-Z only.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = hashes(words)
    return np.unique(windows(ids, min(width, len(words))))
