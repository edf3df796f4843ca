"""Streams that go on where they stopped: new files only, retries, merged runs, and the event sweep."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickpulse.session import scratch_path
from tickpulse.streaming import streams
from tickpulse.tables.run_store import RunStore

SCHEMA = "timestamp long, symbol string, sentiment string"
DAY = 86400


def facts(spark, start, n):
    return spark.createDataFrame([(1_600_000_000 + (i * 7919) % (9 * DAY), f"S{i % 3}", "TÍCH_CỰC" if i % 2 else None) for i in range(start, start + n)], SCHEMA)


def totals(rows):
    return sorted((r.window_start, r.symbol, r.positive, r.total) for r in rows.collect())


def want(df):
    start = F.col("timestamp") - F.pmod(F.col("timestamp") - 28800, F.lit(DAY))
    out = df.groupBy(start.cast("timestamp").cast("timestamp_ntz").alias("window_start"), "symbol").agg(F.count(F.when(F.col("sentiment") == "TÍCH_CỰC", 1)).alias("positive"), F.count("*").alias("total"))
    return totals(out)


def test_a_second_run_in_a_new_session_reads_new_files_only(spark):
    source, state = scratch_path(spark, "source"), scratch_path(spark, "state")
    first, second = facts(spark, 0, 60), facts(spark, 60, 25)
    first.repartition(4).write.parquet(source)
    one = streams.tumbling_stock_sentiment(spark, source, first.schema, state, options={"maxFilesPerTrigger": 2})
    assert totals(one) == want(first)
    runs = RunStore(spark, f"{state}/runs", one.schema, []).runs()
    # the files of the first run are replaced by nonsense: only a run that reads them again would see it
    for f in sorted(spark.read.parquet(source).inputFiles()):
        spark.createDataFrame([(0, "WRONG", None)], SCHEMA).coalesce(1).write.mode("overwrite").parquet(scratch_path(spark, "nonsense"))
        with open(f.removeprefix("file://"), "wb") as out:
            out.write(b"not parquet")
    other = spark.newSession()
    second.repartition(2).write.mode("append").parquet(source)
    two = streams.tumbling_stock_sentiment(other, source, first.schema, state)
    assert totals(two) == want(first.unionByName(second))
    assert len(RunStore(other, f"{state}/runs", one.schema, []).runs()) == len(runs) + 1
    # nothing new: nothing is read, the result stays
    assert totals(streams.tumbling_stock_sentiment(other, source, first.schema, state)) == want(first.unionByName(second))


def summed(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


@pytest.fixture
def store(spark):
    return RunStore(spark, scratch_path(spark, "runs"), spark.createDataFrame([], "k string, n long").schema, ["k"], fan=3)


def put(spark, store, batch_id, n=1):
    store.put(batch_id, spark.createDataFrame([("a", n), (f"b{batch_id}", n)], "k string, n long"))


def test_a_batch_tried_again_changes_nothing(spark, store):
    for i in (0, 1, 1, 0):
        put(spark, store, i)
    assert {r.k: r.n for r in summed(store.read()).collect()} == {"a": 2, "b0": 1, "b1": 1}
    put(spark, store, 2)
    store.compact(summed)
    assert [(r["low"], r["high"], r["level"]) for r in store.runs()] == [(0, 2, 1)]
    put(spark, store, 1)  # after its run was merged
    assert {r.k: r.n for r in summed(store.read()).collect()} == {"a": 3, "b0": 1, "b1": 1, "b2": 1}


def test_runs_merge_by_levels(spark, store):
    for i in range(10):
        put(spark, store, i, i)
        store.compact(summed)
        assert sum(r["high"] - r["low"] + 1 for r in store.runs()) == i + 1
    assert [(r["low"], r["high"], r["level"]) for r in store.runs()] == [(0, 8, 2), (9, 9, 0)]
    assert {r.k: r.n for r in summed(store.read()).collect()} == {"a": 45} | {f"b{i}": i for i in range(10)}


def test_a_merge_that_fails_leaves_the_runs(spark, store):
    for i in range(3):
        put(spark, store, i)
    with pytest.raises(ZeroDivisionError):
        store.compact(lambda rows: 1 / 0)
    assert summed(store.read()).where("k = 'a'").first().n == 3


@pytest.mark.parametrize("hours", [1, 3, 24])
def test_the_sweep_equals_laying_out_every_window(spark, hours):
    r = random.Random(hours)
    rows = [(h * 3600, t, r.randint(1, 9)) for t in ("a", "b") for h in sorted(r.sample(range(100), 12))]
    got = {(x.window_start, x.token): x.n for x in streams.sweep_windows(spark.createDataFrame(rows, "hour long, token string, n long"), hours).collect()}
    expect = {}
    for h, t, n in rows:
        for k in range(hours):
            key = (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=h - 3600 * k), t)
            expect[key] = expect.get(key, 0) + n
    assert got == expect


def test_the_sweep_shuffles_two_rows_per_hour_and_token(spark):
    plan = streams.sweep_windows(spark.createDataFrame([(0, "a", 1)], "hour long, token string, n long"), 24)
    text = plan._jdf.queryExecution().executedPlan().toString()
    below = text[text.rindex("Exchange"):]  # the plan prints the last shuffle first, its input below it
    assert below.count("Generate") == 1 and "sequence" not in below
