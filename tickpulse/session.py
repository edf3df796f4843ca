"""Session construction and shared-storage locations."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, cpus: int | None = None, app: str = "tickpulse") -> SparkSession:
    """A session tuned for the library's jobs.

    On a cluster ``master`` is left to ``spark-submit``; locally ``local[cpus]``.
    AQE stays on so shuffle partitions coalesce at run time and skewed join
    partitions are split.
    """
    builder = SparkSession.builder.appName(app)
    if master is None and cpus is not None:
        master = f"local[{cpus}]"
    if master is not None:
        builder = builder.master(master)
    if cpus is not None:  # a local run; a cluster's own setting stands
        builder = builder.config("spark.sql.shuffle.partitions", str(max(8, 2 * cpus)))
    return (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TICKPULSE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The configured value always wins.  Only when nothing is configured (unit
    tests, local runs) is a folder chosen and registered here.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return spark.sparkContext.getCheckpointDir() or conf_dir
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    # local runs and tests only: nothing configured, so pick a folder on this machine
    local = os.environ.get("TICKPULSE_CHECKPOINT_DIR", "/tmp/tickpulse-checkpoints")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written intermediate table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"
