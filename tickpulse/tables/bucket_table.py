"""A keyed table on files: unique-key inserts, upserts and replace-by-key that are written and committed (inventory 2.2).

Rows are dealt into buckets by a 64-bit hash of their key; a second hash tells the keys of a bucket apart, so a long
text in a key is neither shuffled nor compared as a key.  A manifest (``manifest.py``) lists every bucket's files and is
swapped last: readers see the version before or the version after, never half a write.

* ``update`` and ``replace`` read and rewrite only the buckets that incoming keys fall in (copy on write);
* ``ignore`` and ``append`` write new files beside a bucket's old ones and read the old ones' key hashes only; ``compact``
  brings buckets of several files back to few.

A key with a NULL never conflicts, as with SQL unique constraints.  Rows of a batch with one key are first reduced to one in
every task (``min_by`` / ``max_by``), so a heavily repeated key is never gathered anywhere.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickpulse.operators.upsert import dedup_batch, key_hashes
from tickpulse.session import scratch_path
from tickpulse.tables import manifest

_K = ("_k1", "_k2")
_MODES = ("update", "ignore", "replace", "append")


class BucketTable:
    """``BucketTable.create(spark, path, schema, keys)`` makes a table, ``BucketTable(spark, path)`` opens one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        version, content = manifest.latest(spark, self.path)
        if version < 0:
            raise FileNotFoundError(f"no table at {path}")
        self.schema = StructType.fromJson(content["schema"])
        self.keys, self.buckets = content["keys"], content["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64) -> BucketTable:
        """An empty table.  ``buckets`` should leave some hundred MB in each at the size the table will have."""
        clash = [c for c in (*_K, "_bucket") if c in schema.names]
        if clash or any(k not in schema.names for k in keys):
            raise ValueError(f"keys must be columns, and {clash or _K} cannot be")
        content = {"schema": schema.jsonValue(), "keys": keys, "buckets": buckets, "files": {}}
        manifest.commit(spark, path.rstrip("/"), 0, content)
        return cls(spark, path)

    @classmethod
    def of(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> BucketTable:
        """A table that holds ``rows`` as they are."""
        table = cls.create(rows.sparkSession, path, rows.schema, keys, buckets)
        table.merge(rows, "append")
        return table

    # ------------------------------------------------------------ reading
    @property
    def version(self) -> int:
        return manifest.latest(self.spark, self.path)[0]

    def files(self, version: int | None = None) -> dict[int, list[str]]:
        """The files of each bucket."""
        content = manifest.latest(self.spark, self.path)[1] if version is None else manifest.at_version(self.spark, self.path, version)
        return {int(b): [f"{self.path}/data/{f}" for f in names] for b, names in content["files"].items()}

    def _scan(self, files: list[str], internal: bool = False) -> DataFrame:
        stored = StructType(list(self.schema.fields)).add("_k1", "long").add("_k2", "long")
        found = self.spark.read.schema(stored).parquet(*files) if files else self.spark.createDataFrame([], stored)
        return found if internal else found.drop(*_K)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest committed version, or of an older one."""
        return self._scan([f for names in self.files(version).values() for f in names])

    # ------------------------------------------------------------ writing
    def _bucket(self) -> Column:
        return F.pmod("_k1", F.lit(self.buckets)).cast("int")

    def _keyed(self, incoming: DataFrame, mode: str, order: list | None) -> DataFrame:
        """The batch with its key hashes, one row per key where the mode asks for it."""
        rows = incoming.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], F.struct(*(order or self.keys)).alias("_order"))
        rows = rows.select("*", *key_hashes(self.keys, self.schema.names, *_K))
        if mode in ("update", "ignore"):
            rows = dedup_batch(rows, list(_K), ["_order"], keep="last" if mode == "update" else "first", null_apart="_k2")
        return rows.drop("_order").withColumn("_bucket", self._bucket())

    def merge(self, incoming: DataFrame, mode: str = "update", order: list | None = None) -> int:
        """Write a batch and commit it; returns the new version (the present one where nothing was written).

        ``update``: the last row of the batch per key (by ``order``) replaces the table's; ``ignore``: the first row per key is added
        where the table has no such key; ``replace``: all rows of each incoming key go and the batch's rows come; ``append``:
        all rows are added.
        """
        if mode not in _MODES:
            raise ValueError(f"unknown mode {mode!r}")
        spark = self.spark
        version, content = manifest.latest(spark, self.path)
        staged = scratch_path(spark, "batch")  # read for its buckets, its keys and its rows: written once
        self._keyed(incoming, mode, order).write.parquet(staged)
        batch = spark.read.parquet(staged)
        touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())  # at most the number of buckets
        if not touched:
            return version
        files = {int(b): names for b, names in content["files"].items()}
        old = self._scan([f"{self.path}/data/{f}" for b in touched for f in files.get(b, [])], internal=True)
        if mode in ("update", "replace"):
            gone = batch.select(*_K).where("_k2 is not null").distinct()
            out = old.join(gone, list(_K), "left_anti").select(*old.columns, self._bucket().alias("_bucket")).unionByName(batch)
        elif mode == "ignore":
            out = batch.join(old.select(*_K).where("_k2 is not null"), list(_K), "left_anti").select(*batch.columns)
        else:
            out = batch
        made = self._write(out)
        if mode in ("update", "replace"):
            files |= {b: made.get(b, []) for b in touched}
        elif made:
            files |= {b: files.get(b, []) + names for b, names in made.items()}
        else:
            return version
        return self._commit(version, content, files)

    def compact(self, most_files: int = 4) -> int:
        """Rewrite the buckets of more than ``most_files`` files; the rows stay as they are."""
        version, content = manifest.latest(self.spark, self.path)
        files = {int(b): names for b, names in content["files"].items()}
        many = [b for b, names in files.items() if len(names) > most_files]
        if not many:
            return version
        rows = self._scan([f"{self.path}/data/{f}" for b in many for f in files[b]], internal=True)
        files |= self._write(rows.withColumn("_bucket", self._bucket()))
        return self._commit(version, content, files)

    def _write(self, rows: DataFrame) -> dict[int, list[str]]:
        """New data files by bucket.  The rebalance gives a bucket one file, or several where it is large."""
        run = uuid.uuid4().hex
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{run}")
        made = defaultdict(list)
        for f in manifest.files_below(self.spark, f"{self.path}/data/{run}"):
            _, _, inner = f.rpartition(f"/{run}/")
            made[int(inner.split("/")[0].removeprefix("_bucket="))].append(f"{run}/{inner}")
        return dict(made)

    def _commit(self, version: int, content: dict, files: dict[int, list[str]]) -> int:
        manifest.commit(self.spark, self.path, version + 1, content | {"files": {str(b): names for b, names in sorted(files.items()) if names}})
        return version + 1
