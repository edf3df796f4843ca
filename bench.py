"""Headline-query benchmark.

Runs the flagship flows at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line with per-query seconds.  Each
query is executed end to end into Spark's ``noop`` sink (full computation, no
collect to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flow_stock_sentiment",
    "flow_daily_statistics",
    "flow_trending_2days",
    "flow_trending_daily",
    "flow_process_posts",
    "flow_process_replies",
    "flow_detect_rumors",
    "flow_rewrite_rumors",
    "flow_calendar",
    "fn_ticker_rules",
    "flow_yt_mentions",
    "fn_rouge_1",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tickpulse.plans.registry import load_all
    from tickpulse.session import build_session

    spark = build_session(cpus=cpus, app="tickpulse-bench")
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    # warm-up: JVM, parquet footers, codegen caches
    reg["agg_daily_statistics"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
