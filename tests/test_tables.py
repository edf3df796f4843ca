"""Committed tables: merges against a dictionary, buckets touched, failed and concurrent writes."""

import random

import pytest
from pyspark.sql import functions as F

from tickpulse.session import scratch_path
from tickpulse.tables import manifest
from tickpulse.tables.bucket_table import BucketTable

SCHEMA = "k1 long, k2 string, v string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    return BucketTable.create(spark, scratch_path(spark, "table"), schema, ["k1", "k2"], buckets=16)


def batch(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", n long").repartition(3)


def test_merges_equal_a_dictionary(spark, table):
    """Each mode over keys that repeat, with NULLs, through several commits."""
    r = random.Random(1)
    want = []
    for step, mode in enumerate(["append", "update", "ignore", "update", "replace", "ignore"]):
        rows = [(r.choice([1, 2, 3, 4, None]), r.choice(["a", "b" * 5000, None]), f"{step}.{i}") for i in range(12)]
        keyed = lambda x: x[0] is not None and x[1] is not None
        have = {x[:2] for x in want if keyed(x)}
        if mode == "update":
            last = {x[:2]: x for x in rows if keyed(x)}
            want = [x for x in want if x[:2] not in last] + list(last.values()) + [x for x in rows if not keyed(x)]
        elif mode == "ignore":
            first = {x[:2]: x for x in reversed(rows) if keyed(x) and x[:2] not in have}
            want += list(first.values()) + [x for x in rows if not keyed(x)]
        elif mode == "replace":
            gone = {x[:2] for x in rows if keyed(x)}
            want = [x for x in want if x[:2] not in gone] + rows
        else:
            want += rows
        table.merge(batch(spark, rows), mode, ["n"])
        assert rows_of(BucketTable(spark, table.path).read()) == sorted(want, key=str), (step, mode)
    assert table.compact(0) == table.version == 7
    assert rows_of(table.read()) == sorted(want, key=str)


def test_a_small_update_rewrites_only_its_buckets(spark, table):
    rows = [(i, f"key {i}", "old") for i in range(1000)]
    table.merge(batch(spark, rows), "append")
    before = table.files()
    assert len(before) == 16
    table.merge(batch(spark, [(7, "key 7", "new"), (7, "key 7", "newer")]), "update", ["n"])
    after = table.files()
    changed = [b for b in before if before[b] != after[b]]
    assert len(changed) == 1
    assert table.read().where("v = 'newer'").count() == 1 and table.read().count() == 1000
    # the old version still reads as it was
    assert table.read(1).where("v <> 'old'").count() == 0


def test_inserts_leave_old_files_alone(spark, table):
    table.merge(batch(spark, [(i, "x", "old") for i in range(200)]), "append")
    before = table.files()
    version = table.version
    assert table.merge(batch(spark, [(i, "x", "again") for i in range(200)]), "ignore") == version
    table.merge(batch(spark, [(i, "x", "again") for i in range(190, 210)]), "ignore")
    after = table.files()
    assert all(set(before[b]) <= set(after[b]) for b in before)
    assert table.read().count() == 210 and table.read().where("v = 'again'").count() == 10


def test_a_failed_write_leaves_the_version_before(spark, table):
    table.merge(batch(spark, [(1, "a", "old")]), "append")

    @F.udf("string")
    def fail(v):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        table.merge(batch(spark, [(1, "a", "new")]).withColumn("v", fail("v")), "update")
    assert rows_of(BucketTable(spark, table.path).read()) == [(1, "a", "old")]


def test_a_write_that_fails_before_its_manifest(spark, table, monkeypatch):
    table.merge(batch(spark, [(1, "a", "old")]), "append")
    monkeypatch.setattr(manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.merge(batch(spark, [(1, "a", "new")]), "update")
    assert rows_of(BucketTable(spark, table.path).read()) == [(1, "a", "old")]


def test_two_writers_cannot_commit_one_version(spark, table, monkeypatch):
    stale = manifest.latest(spark, table.path)
    table.merge(batch(spark, [(1, "a", "first")]), "append")
    monkeypatch.setattr(manifest, "latest", lambda *a: stale)
    with pytest.raises(manifest.ConflictError):
        table.merge(batch(spark, [(2, "b", "second")]), "append")
    monkeypatch.undo()
    assert rows_of(table.read()) == [(1, "a", "first")]


def test_keys_are_not_shuffled_as_texts(spark, table):
    table.merge(batch(spark, [(1, "long " * 100, "v")]), "append")
    schema = table._scan([f for x in table.files().values() for f in x], internal=True).schema
    assert schema["_k1"].dataType.simpleString() == schema["_k2"].dataType.simpleString() == "bigint"


def test_nothing_to_write(spark, table):
    assert table.merge(batch(spark, []), "update") == 0
    assert table.read().count() == 0
    with pytest.raises(FileNotFoundError):
        BucketTable(spark, scratch_path(spark, "no-table"))
    with pytest.raises(ValueError):
        table.merge(batch(spark, []), "upsert")
