"""The ledger of processed posts: which (platform, post, content) a run has finished.

A bucketed table of hashes that lies in the order of the anti-join's keys, so a run shuffles the arriving posts only and
reads the history bucket by bucket, however long it is.  The files carry the bucket in their names; a session that
opens the folder registers the table again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickpulse.operators.common import content_keys

_KEYS = ["platform", "post_id", "k1", "k2"]


class Ledger:
    """``Ledger(spark, path)`` opens the ledger at ``path`` or makes an empty one; ``buckets`` must stay the same for a path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.table = "processed_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        where = path if "://" in path or not path.startswith("/") else f"file://{path}"
        columns = "platform STRING, post_id STRING, k1 BIGINT, k2 BIGINT"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet CLUSTERED BY ({', '.join(_KEYS)}) INTO {buckets} BUCKETS LOCATION '{where}'")

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    @staticmethod
    def _keyed(posts: DataFrame) -> DataFrame:
        """The posts with their ledger key; a NULL platform, id or content has a key of its own, so nothing is read twice."""
        k1, k2 = content_keys("content")
        same = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("platform", "post_id")]
        return posts.select("*", *same, k1, k2)

    def unprocessed(self, posts: DataFrame) -> DataFrame:
        """The posts that no run has finished: one shuffle of the posts, none of the ledger."""
        keyed, done = self._keyed(posts), self.read()
        on = [keyed[f"_{c}"] == done[c] for c in ("platform", "post_id")] + [keyed["_k1"] == done["k1"], keyed["_k2"] == done["k2"]]
        return keyed.join(done, on, "left_anti").select(*posts.columns)

    def add(self, posts: DataFrame) -> None:
        """Enter the posts as finished; every bucket gets one file per run."""
        rows = self._keyed(posts).select(F.col("_platform").alias("platform"), F.col("_post_id").alias("post_id"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"))
        rows.distinct().repartition(self.buckets, *_KEYS).write.insertInto(self.table)
