"""Tables that a plan reads more than once: computed once where they are first needed, and released by the caller.

    with store.scope(spark):
        BlockedLsh(...).join(vectors).write.parquet(path)
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of up to so many rows of a few numbers are broadcast.
MOST_ROWS = 100_000
_held: list[DataFrame] = []


def hold(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Persists df, lazily: what an executor takes with it is computed again."""
    df = df.persist(level)
    _held.append(df)
    return df


def release(spark: SparkSession) -> int:
    """Unpersists all that is held in this session, when results are written; returns how many tables that were."""
    mine = [df for df in _held if df.sparkSession is spark]
    _held[:] = [df for df in _held if df.sparkSession is not spark]
    for df in mine:
        df.unpersist()
    return len(mine)


@contextmanager
def scope(spark: SparkSession, description: str | None = None) -> Iterator[None]:
    """Releases what is held within it; `description` names its jobs in the UI."""
    before = list(_held)
    if description is not None:
        spark.sparkContext.setJobDescription(description)
    try:
        yield
    finally:
        if description is not None:
            spark.sparkContext.setJobDescription(None)
        for df in [df for df in _held if all(df is not x for x in before)]:
            _held.remove(df)
            df.unpersist()


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate files, below the one that spark.checkpoint.dir names; a temporary one in local mode if none is set."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="kindred-")
    return f"{top}/kindred-{uuid.uuid4().hex}"


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows: these are counted, once."""
    df = hold(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
