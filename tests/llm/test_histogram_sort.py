import random
import zlib

from pyspark.sql import functions as F

from tickpulse.llm.histogram_sort import shard


def rows_of(seed, n):
    r = random.Random(seed)
    return [(i * 7 - 500, "é" * r.choice([0, 1, 5, 40, 900])) for i in range(n)]


def check(spark, rows, shards, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Slot", F.lit("mine")).withColumn("lang", F.lit("x")).repartition(5)
    out = shard(docs, shards, **kw)
    assert sorted(out.columns) == ["doc_id", "lang", "shard", "slot", "text"]
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    size = lambda t: len((t or "").encode()) + 16
    by = {}
    for r in got:
        assert 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    low = lambda r: -(1 << 63) if r.doc_id is None else r.doc_id
    keys = [(min(map(low, p)), max(map(low, p))) for _, p in sorted(by.items())]
    assert all(a[1] <= b[0] for a, b in zip(keys, keys[1:]))  # key order over shards
    return {s: sum(size(r.text) for r in p) for s, p in by.items()}


def test_bytes_near_equal(spark):
    rows = rows_of(1, 4000)
    total = sum(len(t.encode()) + 16 for _, t in rows)
    for part_bytes in (1 << 24, 2000):
        got = check(spark, rows, 7, part_bytes=part_bytes)
        assert len(got) == 7
        assert all(abs(v - total / 7) <= 2000 for v in got.values())  # one long row at most on each side


def test_hot_sort_value_is_split(spark):
    rows = [(5, f"text {i:05d}") for i in range(900)] + [(i, "t") for i in range(100, 200)]
    got = check(spark, rows, 4)
    assert max(got.values()) <= 1.05 * sum(got.values()) / 4


def test_odd_rows(spark):
    check(spark, [], 3)
    check(spark, [(1, "x")], 3)
    check(spark, [(None, None), (None, "a"), (1, None), (2, "z" * 200_000), (3, ""), (3, ""), (3, "")], 3)
    assert zlib.crc32(b"") == 0


def test_no_column_is_lost(spark):
    """Only ``shard`` and ``slot`` are the operator's; names that look private stay."""
    docs = spark.createDataFrame([(i, f"t{i}", 7, 8, 9, 10, 11) for i in range(30)], "doc_id long, text string, _value int, _part int, _size int, __tie int, shard int")
    got = shard(docs, 3)
    assert sorted(got.columns) == sorted([*docs.columns, "slot"])
    assert {(r["_value"], r["_part"], r["_size"], r["__tie"]) for r in got.collect()} == {(7, 8, 9, 10)}
    assert {r.shard for r in got.collect()} == {0, 1, 2}
