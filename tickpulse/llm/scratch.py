"""Shared scratch folder for written intermediates (the folder the cluster names in ``spark.checkpoint.dir``)."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_dir(application: str) -> str:
    """The folder of a local session that names none; the setting itself cannot be changed while a session runs."""
    return "file://" + tempfile.mkdtemp(prefix="llm-shared-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir(spark.sparkContext.applicationId)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most from here on: a worker holds a batch several times over while it works on its texts."""
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    if not size.startswith("8388608"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8388608b")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write go when it ends; else they stay until the driver's JVM happens to collect its garbage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: what came of them has been written itself."""
    for t in tables:
        discard_folder(t.sparkSession, t._written_at)


def discard_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
