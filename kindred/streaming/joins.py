"""Joins of a stream of query vectors with a catalog that stands still."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.joiners import QueryJoiner


def join_batches(queries: DataFrame, catalog: DataFrame, joiner: QueryJoiner, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that joins each batch of (id, vector) as it comes and hands the pairs to sink(pairs, batch id).

    Planes come from the joiner's seed, so a query finds the same neighbours whichever batch it comes in, and a repeated
    batch gives the same pairs: a sink that overwrites by batch id sees each exactly once. Set the
    checkpoint location and the trigger on the writer, and start it.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(joiner.join(batch, catalog), number)

    return queries.select("id", "vector").writeStream.foreachBatch(each)
