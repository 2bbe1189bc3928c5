"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; in local mode one of our own, if none is set."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kindred-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder: later steps reread it, also when an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Computes df once onto the executors' disks, since several steps read it.

    What an executor takes with it is computed again from what df is made of. So this is for a first pass over the
    input, whose rows are always the same, and cut() for all that follows. It stays until release(), or the session ends.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()  # else steps that run at once each begin to compute it
    _kept.append(df)
    return df


def release(spark: SparkSession) -> None:
    """Takes what operators have kept in this session off the executors' disks: to be called when their results are written."""
    mine = [df for df in _kept if df.sparkSession is spark]
    _kept[:] = [df for df in _kept if df.sparkSession is not spark]
    for df in mine:
        df.unpersist()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files, by the file system that Spark wrote it to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge list, as (node, root): root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, shortens the hooks by jumping, and relabels the
    edges by what they hang on; edges within one tree vanish. A star or a clique needs one round, a path a
    logarithm of its length. All groupings are minima, combined before the shuffle, so a hub costs one row
    per task. Only nodes that have an edge to another node are returned; nulls and loops are ignored.
    """
    edges = cut(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    )
    roots = None
    while not edges.isEmpty():
        hooks = (
            edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
            .groupBy(F.col("e.u").alias("node"))
            .agg(F.min("e.v").alias("low"))
            .select("node", F.least("node", "low").alias("up"))
        )
        hooks = cut(hooks)
        for _ in range(2):
            over = hooks.select(F.col("node").alias("up"), F.col("up").alias("over"))
            hooks = hooks.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"))
        hooks = cut(hooks)
        if roots is None:
            roots = hooks.select("node", F.col("up").alias("root"))
        else:
            step = hooks.select(F.col("node").alias("root"), "up")
            roots = cut(roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        hu, hv = (hooks.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "uv")
        edges = cut(
            edges.join(hu, "u").join(hv, "v")
            .select(F.least("u_up", "v_up").alias("u"), F.greatest("u_up", "v_up").alias("v"))
            .where("u < v").distinct()
        )
    if roots is None:
        roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
