"""Intermediate tables in the shared folder that the cluster names.

Every lineage cut of the operators is a Parquet table below
``spark.checkpoint.dir``: it survives lost executors and, unlike a cached block,
gives the optimizer true sizes, so a broadcast join is chosen only for a side
that was measured to be small.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []
#: Spark's setting that deletes a query's shuffle files as it ends, not when the driver collects garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whole texts go to Python and back: a session that has Spark's own limits of an Arrow batch gets smaller ones.
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000")}
#: A table gets a file for each so many bytes, but not less files than the cluster has cores.
FILE_BYTES = 4 << 20
#: Largest table of keys, in rows of some 20 bytes, that is broadcast; beyond it a join is a shuffle.
BROADCAST_ROWS = 400_000
_RECORDS: list[list[Scratch]] = []


def bound_batches(spark: SparkSession) -> None:
    """Bound what a task hands to Python at once, by bytes, unless the session has limits of its own.

    The limits hold when a plan is run, after an operator has returned it, so they stay set.
    """
    for key, (default, ours) in _BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode one of our own where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _LOCAL_ROOT[0]


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined(left: DataFrame, keys: DataFrame, on, how: str) -> DataFrame:
    """left joined with a written table of keys, which is broadcast if it was counted to be small."""
    return left.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("merge"), on, how)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


@contextmanager
def recorded() -> Iterator[list[Scratch]]:
    """The Scratch folders that are made within, for their deletion once nothing lazy reads them any more."""
    _RECORDS.append([])
    try:
        yield _RECORDS[-1]
    finally:
        _RECORDS.pop()


class Scratch:
    """A folder of intermediate tables belonging to one run of one operator; root names one that is there already."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None) -> None:
        self.spark = spark
        self.root = root.rstrip("/") if root else f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        bound_batches(spark)
        for made in _RECORDS:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        """Whether the table was written to its end."""
        return exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def save(self, df: DataFrame, name: str, like: DataFrame | None = None) -> DataFrame:
        """Write df as a table and return a DataFrame that reads it.

        A small table is written by as few tasks as its size needs, else every task
        of a wide shuffle would leave a small file.  The size is the optimizer's
        estimate of df, or of like, where df is a join that it overestimates.
        """
        size = (df if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        tasks = max(self.spark.sparkContext.defaultParallelism, math.ceil(size / FILE_BYTES))
        few = df.coalesce(tasks) if tasks < int(self.spark.conf.get("spark.sql.shuffle.partitions")) else df
        before = self.spark.conf.get(_FREE)
        self.spark.conf.set(_FREE, "true")
        try:
            few.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(_FREE, before)
        return self.read(name, df.schema)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing lazy reads any more; without names, all of them."""
        for path in [self.path(n) for n in names] or [self.root]:
            remove(self.spark, path)
