"""Written intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Spark's own switch: shuffle files of a finished write are deleted at once instead of at some later collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode, removed at exit.

    On a cluster every executor has its own disk, so a folder that nobody named
    cannot be shared and is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    chosen = context.getCheckpointDir()
    if chosen is None:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master is {master})")
        folder = tempfile.mkdtemp(prefix="fieldtally-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        chosen = context.getCheckpointDir()
    return chosen


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where a result feeds several branches of a plan: it is computed once,
    survives lost executors, keeps column pruning, and its true size on disk
    lets the planner decide whether a join may broadcast it. The files go when
    the session's JVM ends; the shuffle files of the write go with the write.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/fieldtally-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
