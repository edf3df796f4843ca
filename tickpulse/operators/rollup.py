"""Roll-ups of the all_content fact table: daily statistics, per-ticker
sentiment for 24h / week / month, the top-10, and processing counters.

Each roll-up is one partial+final hash aggregation; no scan is repeated per
metric (the conditional counts share one pass).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickpulse.constants import NEGATIVE, NEUTRAL, POSITIVE, STAT_SOURCES, TOP_STOCKS
from tickpulse.functions.timewin import as_datetime, day_anchor, half_open_day, interval_bounds, to_epoch, ts_of_epoch

import datetime as dt


def _count_if(cond):
    return F.count(F.when(cond, F.lit(1)))


def _stat_aggs():
    s = F.col("sentiment")
    aggs = [
        F.count(F.lit(1)).alias("total"),
        _count_if(s == POSITIVE).alias("total_positive"),
        _count_if(s == NEGATIVE).alias("total_negative"),
        _count_if(s == NEUTRAL).alias("total_neutral"),
    ]
    aggs += [_count_if(F.col("source") == src).alias(src) for src in STAT_SOURCES]
    return aggs


def _with_aim(df: DataFrame) -> DataFrame:
    total = F.when(F.col("total") == 0, F.lit(1)).otherwise(F.col("total"))
    return df.withColumn("aim_score", F.col("total_positive") / total * F.lit(100.0))


STAT_COLUMNS = ["timestamp", "total", "total_positive", "total_negative", "total_neutral",
                "news", "fireant", "zalo", "facebook", "youtube", "tiktok", "aim_score"]


def daily_statistics(all_content: DataFrame, run_time) -> DataFrame:
    """agg_daily_statistics: one row for [yesterday 00:00, today 00:00), even on empty input."""
    start, end = half_open_day(run_time, 0)
    window = all_content.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    out = window.agg(*_stat_aggs()).withColumn("timestamp", F.lit(start).cast("bigint"))
    return _with_aim(out).select(*STAT_COLUMNS)


def daily_statistics_all_days(all_content: DataFrame) -> DataFrame:
    """The same statistics for every UTC day present, keyed by the day's start epoch."""
    day = (F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(86400))).alias("timestamp")
    out = all_content.groupBy(day).agg(*_stat_aggs())
    return _with_aim(out).select(*STAT_COLUMNS)


def recent_statistics(stats: DataFrame, run_time, days: int = 7) -> DataFrame:
    """src_recent_stats + sort_recent_stats: rows since midnight ``days`` ago, newest first."""
    start = to_epoch(day_anchor(run_time) - dt.timedelta(days=days))
    out = stats.where(F.col("timestamp") >= start).select(
        F.date_format(ts_of_epoch("timestamp"), "yyyy-MM-dd").alias("date"), *STAT_COLUMNS[1:], "timestamp")
    return out.orderBy(F.desc("timestamp"))


def stock_sentiment(all_content: DataFrame, interval: str, run_time) -> DataFrame:
    """agg_stock_sentiment: per-symbol sentiment counts inside the interval (both ends inclusive)."""
    start, end = interval_bounds(interval, run_time)
    s = F.col("sentiment")
    rows = all_content.where(F.col("symbol").isNotNull() & F.col("timestamp").between(start, end))
    return rows.groupBy("symbol").agg(
        F.sum(F.when(s == POSITIVE, 1).otherwise(0)).alias("positive"),
        F.sum(F.when(s == NEGATIVE, 1).otherwise(0)).alias("negative"),
        F.sum(F.when(s == NEUTRAL, 1).otherwise(0)).alias("neutral"),
        F.count("symbol").alias("total"),
    ).select("symbol", F.lit(interval).alias("interval"), "positive", "negative", "neutral", "total",
             F.lit(end).cast("bigint").alias("timestamp"))


def stock_sentiment_all_intervals(all_content: DataFrame, run_time,
                                  intervals=("24h", "week", "month")) -> DataFrame:
    """All intervals in one scan: each row is tagged (explode) with every interval whose bounds
    contain it, then one aggregation per (interval, symbol).  No join is needed."""
    bounds_rows = [(i, *interval_bounds(i, run_time)) for i in intervals]
    bounds = F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(a).cast("bigint").alias("b_start"),
                                F.lit(b).cast("bigint").alias("b_end")) for i, a, b in bounds_rows])
    lo = min(b[1] for b in bounds_rows)
    hi = max(b[2] for b in bounds_rows)
    ts = F.col("timestamp")
    facts = all_content.where(F.col("symbol").isNotNull() & ts.between(lo, hi)).select(
        "symbol", "sentiment", F.explode(F.filter(bounds, lambda b: ts.between(b["b_start"], b["b_end"]))).alias("b"))
    s = F.col("sentiment")
    return facts.groupBy(F.col("b.interval").alias("interval"), "symbol", F.col("b.b_end").alias("timestamp")).agg(
        F.sum(F.when(s == POSITIVE, 1).otherwise(0)).alias("positive"),
        F.sum(F.when(s == NEGATIVE, 1).otherwise(0)).alias("negative"),
        F.sum(F.when(s == NEUTRAL, 1).otherwise(0)).alias("neutral"),
        F.count("symbol").alias("total"),
    ).select("symbol", "interval", "positive", "negative", "neutral", "total", "timestamp")


def latest_of_interval(stock_sent: DataFrame, interval: str) -> DataFrame:
    """join_scalar_latest: rows of ``interval`` whose timestamp is that interval's maximum."""
    rows = stock_sent.where(F.col("interval") == interval)
    latest = rows.agg(F.max("timestamp")).scalar()  # scalar subquery, run once
    return rows.where(F.col("timestamp") == latest)


def top_stocks(stock_sent: DataFrame, interval: str, n: int = TOP_STOCKS) -> DataFrame:
    """win_top10_rank: top-n by total (ties by symbol) of the latest roll-up, ranked 1..n.

    The ordering is a TakeOrderedAndProject (each task keeps n rows); the rank
    is numbered on those n rows only.
    """
    latest = latest_of_interval(stock_sent, interval)
    top = latest.orderBy(F.desc("total"), F.asc("symbol")).limit(n)
    w = Window.orderBy(F.desc("total"), F.asc("symbol"))
    return top.select("symbol", F.lit(interval).alias("interval"), "positive", "negative", "neutral", "total",
                      F.row_number().over(w).alias("row_num"), F.col("timestamp").alias("updated_at"))


def processing_stats(rumors: DataFrame, analyst: DataFrame) -> DataFrame:
    """agg_processing_stats: total rumors, distinct processed ids, processing rate in percent."""
    done = analyst.agg(F.countDistinct("processed_from_rumor_id")).scalar()
    both = rumors.agg(F.count(F.lit(1)).alias("total_rumors")).withColumn("processed_rumors", done)
    rate = F.when(F.col("total_rumors") > 0,
                  F.col("processed_rumors") / F.col("total_rumors") * F.lit(100.0)).otherwise(F.lit(0.0))
    return both.select("total_rumors", "processed_rumors", rate.alias("processing_rate"))
