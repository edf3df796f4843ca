"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_keys(col: str = "content") -> list[Column]:
    """Two independent 64-bit hashes that stand for a long text as a shuffle key."""
    c = F.col(col)
    return [F.xxhash64(c).alias("_k1"), F.xxhash64(F.lit("second"), c).alias("_k2")]


def materialize(df: DataFrame) -> DataFrame:
    """Compute a small intermediate once: a reliable checkpoint in the cluster's shared folder, so all
    later branches and a lost executor read it instead of computing it again."""
    from tickpulse.session import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table too small to fill the cluster over all of its cores, before work that is heavy per row.

    A file of one row group is read by one task, whatever its number of splits.  Only the rows' place changes; a table of
    as many bytes as the cores read in one wave is left as its files are, so a large one is never shuffled for this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    wave = cores * int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores, *keys) if size < wave else df
