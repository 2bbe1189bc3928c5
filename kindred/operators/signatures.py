"""Random-hyperplane signatures: bit k is set if a vector lies on the positive side of plane k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hyperplanes


def matrix(column: pa.Array, features: int) -> np.ndarray:
    """A column of equally long vectors as an (n, features) array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * features:
        raise ValueError(f"vectors must have {features} elements")
    return flat.reshape(-1, features)


def positive(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The signs of all projections; NaN and zero are not positive. Added up feature by feature, as SQL does."""
    total = np.zeros((len(x), r.shape[1]))
    for k in range(r.shape[0]):
        total += x[:, k, None] * r[None, k, :]
    return total > 0


def words_of(bits: np.ndarray) -> np.ndarray:
    """(n, words) of 64 bits, the lowest bit first."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little").view("<i8")


def _arrow_words(words: np.ndarray) -> pa.Array:
    n, k = words.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k), pa.int32()), pa.array(words.ravel(), pa.int64()))


def _keys(bits: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())


def with_signature(df: DataFrame, r: np.ndarray) -> DataFrame:
    """Adds to (id, vector) sig_words, for bit arithmetic, and sig_key, whose byte order is the order of bits from bit 0.

    The planes go to the workers with the code; a narrow step, and nothing is joined back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = positive(matrix(batch.column("vector"), r.shape[0]), r)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), _arrow_words(words_of(bits)), _keys(bits)],
                                             names=["id", "vector", "sig_words", "sig_key"])

    return df.select("id", "vector").mapInArrow(run, "id long, vector array<double>, sig_words array<long>, sig_key binary")


def with_signature_sql(df: DataFrame, r: np.ndarray) -> DataFrame:
    """Adds `bits`, a string of 0 and 1, by higher-order functions alone: for few planes, and for comparison."""
    planes = F.array(*(F.array(*map(F.lit, map(float, plane))) for plane in r.T))
    side = lambda p: F.aggregate(F.zip_with("vector", p, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("bits", F.array_join(F.transform(planes, lambda p: F.when((side(p) > 0) & ~F.isnan(side(p)), "1").otherwise("0")), ""))


def keyed_rounds(df: DataFrame, rounds: list[np.ndarray], vectors: bool = True) -> DataFrame:
    """A row (round, id, vector, sig_key) for each row and each set of planes. Permuted planes give permuted bits.

    Without `vectors` that column is left out: rows that are only to be sorted should be narrow.
    """
    names = ["round", "id", *["vector"] * vectors, "sig_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), rounds[0].shape[0])
            own = [batch.column("vector")] * vectors
            for k, r in enumerate(rounds):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), batch.column("id"), *own, _keys(positive(x, r))], names=names)

    return df.select("id", "vector").mapInArrow(run, f"round int, id long,{' vector array<double>,' * vectors} sig_key binary")


def bit_string(bits: int, key: str = "sig_key"):
    """A sig_key as a string of 0 and 1."""
    return F.substring(F.array_join(F.transform(F.split(F.hex(key), ""), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0")), ""), 1, bits)


__all__ = ["bit_string", "hyperplanes", "keyed_rounds", "matrix", "positive", "with_signature", "with_signature_sql", "words_of"]
