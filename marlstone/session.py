"""Session settings and table access shared by the library."""

from __future__ import annotations

import os
import re
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that all executors share (``spark.checkpoint.dir``; a local session may leave it unset)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="marlstone-"))
    return df.checkpoint(eager=True)


def free_shuffles(kept: DataFrame) -> None:
    """Delete the shuffle files that a persisted and computed table was made of, as a table kept on disk would else lie there twice and more.
    If a part of it is lost, Spark finds no outputs and runs the stages again. Shuffles that Spark has cleaned up itself are passed over: those of
    stages that a plan gave up go whenever their objects are collected."""
    session = kept.sparkSession
    plan = session._jsparkSession.sharedState().cacheManager().lookupCachedData(kept._jdf).get().cachedRepresentation().cacheBuilder().cachedPlan()
    if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec":
        return  # only adaptive plans name their shuffles; else the files stay until the table goes
    context = session.sparkContext._jsc.sc()
    tracker = context.env().mapOutputTracker()
    for i in list(plan.context().shuffleIds()):
        try:
            tracker.unregisterAllMapAndMergeOutput(i)
        except Py4JJavaError:
            if tracker.containsShuffle(i):
                raise
        else:
            context.shuffleDriverComponents().removeShuffle(i, True)


def alone(df: DataFrame, *parts: DataFrame) -> DataFrame:
    """``df`` computed and kept on disk, without its shuffle files and the kept ``parts`` that only it was made of. If a part of it is lost,
    Spark makes these again."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    kept.count()
    for part in (kept, *parts):
        free_shuffles(part)
    for part in parts:
        part.unpersist()
    return kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, by Spark's own reader, so that any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
