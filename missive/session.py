"""Session settings and the one place that decides where checkpoints go."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "missive", cpus: str | None = None) -> SparkSession:
    """A session for tests and the benchmark; a cluster job brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        # what a later checkpoint has replaced is removed
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # small test data would otherwise be merged into one task per stage
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local session without one gets a fresh folder, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that end inside go with them: otherwise they stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    with released(df.sparkSession):
        # what a query does with its shuffle files is settled when its frame is made, so it is made anew here
        return df.select("*").checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Checkpoints that nothing refers to any more are removed now, not when the driver's heap happens to fill.

    Spark removes them if `spark.cleaner.referenceTracking.cleanCheckpoints` is set.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def grown(df: DataFrame) -> DataFrame:
    """A table that grows with the input: the join above it sorts both sides and broadcasts neither.

    Spark takes a few columns of a compressed file for a small part of its size. Their rows as a broadcast hash table were 172 MB
    where it expected less than 10, and the driver holds that table.
    """
    return df.hint("merge")
