"""The post job with its ledger: second runs, edited posts, failed runs, and the plan of the anti-join."""

import pytest

from tickpulse.functions.tickers import TickerDictionary
from tickpulse.plans import flows
from tickpulse.session import scratch_path
from tickpulse.tables.ledger import Ledger

SCHEMA = "platform string, post_id string, content string, timestamp long"
DICT = TickerDictionary(["FPT", "HPG"])


def posts(spark, n, edited=()):
    rows = [("facebook" if i % 2 else "zalo", f"p{i}", f"Hôm nay FPT tăng và HPG giảm lần {i}." + (" Sửa." if i in edited else ""), 1000 + i // 2) for i in range(n)]
    return spark.createDataFrame(rows + [("news", "short", "ngắn", 5), ("news", "none", None, 6), (None, "nowhere", "Không có nguồn nào cả.", 7)], SCHEMA)


def table_rows(spark, state):
    return sorted(map(str, flows.content_table(spark, state).read().drop("symbol_key").collect()))


def test_a_second_run_gives_no_rows(spark):
    state = scratch_path(spark, "job")
    first = flows.run_posts(posts(spark, 10), state, DICT)
    assert first.count() == flows.process_posts(posts(spark, 10), DICT).count() > 20
    assert flows.run_posts(posts(spark, 10), state, DICT).count() == 0
    # new posts, seen by a session that has never heard of the ledger
    other = spark.newSession()
    assert flows.run_posts(posts(other, 14), state, DICT).count() == 8
    assert table_rows(spark, state) == sorted(map(str, flows.process_posts(posts(spark, 14), DICT).collect()))


def test_an_edited_post_is_processed_again(spark):
    state = scratch_path(spark, "job")
    flows.run_posts(posts(spark, 6), state, DICT)
    again = flows.run_posts(posts(spark, 6, edited={3}), state, DICT).collect()
    assert {r.symbol for r in again} == {"FPT", "HPG"} and len(again) == 2 and all("lần 3" in r.content for r in again)


def test_a_run_that_fails_before_its_ledger_is_repeated_without_effect(spark, monkeypatch):
    state = scratch_path(spark, "job")
    monkeypatch.setattr(Ledger, "add", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        flows.run_posts(posts(spark, 6), state, DICT)
    monkeypatch.undo()
    before = table_rows(spark, state)
    assert flows.run_posts(posts(spark, 6), state, DICT).count() == len(before)
    assert table_rows(spark, state) == before


def test_the_ledger_is_not_shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ledger = Ledger(spark, scratch_path(spark, "ledger"), buckets=16)
        for n in (5, 9):  # several files per bucket
            ledger.add(posts(spark, n))
        plan = ledger.unprocessed(posts(spark, 12))._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("FileScan parquet")]
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert scan.rindex("Exchange") < scan.rindex("Sort")  # the one exchange is on the side of the posts
        assert sorted(r.post_id for r in ledger.unprocessed(posts(spark, 12)).collect()) == ["p10", "p11", "p9"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
