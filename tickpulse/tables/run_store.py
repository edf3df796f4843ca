"""The output of a stream as sorted runs under a manifest, merged as they accumulate.

Every micro-batch writes one run.  When ``fan`` runs of one level have come together they are combined into one run of
the next level, so a row is rewritten once per level and the number of runs stays logarithmic in the number of batches.
A batch that is tried again replaces its own run, or changes nothing if that run has been merged already.  Manifests
(``manifest.py``) switch versions in one step, so readers never see a batch twice or half a merge.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tickpulse.tables import manifest


class RunStore:
    """Opens the store at ``path``, or makes an empty one for rows of ``schema``, sorted by ``sort`` inside files."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, sort: list[str], fan: int = 8):
        self.spark, self.path, self.schema, self.sort, self.fan = spark, path.rstrip("/"), schema, sort, fan
        if manifest.latest(spark, self.path)[0] < 0:
            manifest.commit(spark, self.path, 0, {"runs": []})

    def runs(self) -> list[dict]:
        """``low, high`` (batches in the run), ``level`` and ``files`` of each run, oldest first."""
        return manifest.latest(self.spark, self.path)[1]["runs"]

    def _scan(self, runs: list[dict]) -> DataFrame:
        files = [f"{self.path}/data/{f}" for r in runs for f in r["files"]]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._scan(self.runs())

    def _write(self, rows: DataFrame) -> list[str]:
        run = uuid.uuid4().hex
        rows.select(*self.schema.names).sortWithinPartitions(*self.sort).write.parquet(f"{self.path}/data/{run}")
        return [f"{run}/{f.rpartition('/')[2]}" for f in manifest.files_below(self.spark, f"{self.path}/data/{run}")]

    def put(self, batch_id: int, rows: DataFrame) -> None:
        """Write the run of one batch."""
        version, content = manifest.latest(self.spark, self.path)
        held = [r for r in content["runs"] if r["low"] <= batch_id <= r["high"]]
        if held and held[0]["level"] > 0:
            return  # tried again after its run was merged
        run = {"low": batch_id, "high": batch_id, "level": 0, "files": self._write(rows)}
        others = [r for r in content["runs"] if r not in held]
        manifest.commit(self.spark, self.path, version + 1, {"runs": sorted([*others, run], key=lambda r: r["low"])})

    def compact(self, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Merge the oldest ``fan`` runs of any level that has so many; ``combine`` reduces their rows without changing what they mean."""
        while True:
            version, content = manifest.latest(self.spark, self.path)
            runs = content["runs"]
            full = [v for v in {r["level"] for r in runs} if sum(r["level"] == v for r in runs) >= self.fan]
            if not full:
                return
            group = [r for r in runs if r["level"] == min(full)][: self.fan]
            one = {"low": group[0]["low"], "high": group[-1]["high"], "level": min(full) + 1, "files": self._write(combine(self._scan(group)))}
            rest = [r for r in runs if r not in group]
            manifest.commit(self.spark, self.path, version + 1, {"runs": sorted([*rest, one], key=lambda r: r["low"])})
