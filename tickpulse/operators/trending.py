"""Trending words: token counts in time windows, growth, dynamic floor, score
and the three top-N lists (inventory 2.5-2.7, flows 2.11).

Data stays in long form ``(token, counts)``: the vocabulary is unbounded, so
nothing is ever pivoted by token.  Token counting is one hash aggregation
with map-side partial counts (a hot token such as 'the' is pre-aggregated in
every task before the shuffle).  The floor needs the maximum count, a
one-row aggregate joined back as a broadcast scalar.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickpulse.constants import TRENDING_ALPHA, TRENDING_BETA, TRENDING_ZONE
from tickpulse.functions.text import clean_token, keep_token, raw_tokens
from tickpulse.functions.timewin import as_datetime, ntz, to_zone
from tickpulse.operators.common import materialize


def _utc_bounds(lo: dt.datetime, hi: dt.datetime, zone: str | None) -> tuple[dt.datetime, dt.datetime]:
    """Stored UTC times that can fall in [lo, hi] of the zone's wall clock (a clock change widens them by its hours)."""
    if zone is None:
        return lo, hi
    from zoneinfo import ZoneInfo

    utc = [(t - t.replace(tzinfo=ZoneInfo(zone)).utcoffset()) for t in (lo, hi)]
    return utc[0] - dt.timedelta(hours=3), utc[1] + dt.timedelta(hours=3)


def exploded_tokens(df: DataFrame, text_col: str = "content", ts_col: str = "date",
                    zone: str | None = TRENDING_ZONE, stopwords=None, between=None) -> DataFrame:
    """fn_tokenize + fn_ensure_token_list + fn_explode_tokens: one (ts, token) row per token.

    Timestamps are converted from UTC to ``zone`` wall clock; rows whose time is NULL are dropped.
    ``between`` (two wall-clock times) first bounds the stored column by literals, which reach the scan.
    """
    if between is not None:
        first, last = _utc_bounds(*between, zone)
        df = df.where((F.col(ts_col) >= ntz(first)) & (F.col(ts_col) <= ntz(last)))
    ts = to_zone(ts_col, zone) if zone else F.col(ts_col).cast("timestamp_ntz")
    # The same rules as ensure_token_list(tokenize(...)), applied after the explode as plain row
    # predicates: they stay inside whole-stage codegen, where array lambdas would be interpreted
    # once per token.
    rows = df.select(ts.alias("ts"), F.explode(raw_tokens(F.col(text_col))).alias("raw"))
    rows = rows.where(F.col("ts").isNotNull() & keep_token(F.col("raw"), stopwords))
    rows = rows.select("ts", clean_token(F.col("raw")).alias("token"))
    return rows.where(F.col("token") != "")


def window_bounds(end_time, align: str | None = "hour"):
    """End anchor (floored to the hour or minute) and the two adjacent 24 h windows."""
    end = as_datetime(end_time)
    if align == "hour":
        end = end.replace(minute=0, second=0, microsecond=0)
    elif align == "minute":
        end = end.replace(second=0, microsecond=0)
    cur = end - dt.timedelta(hours=24)
    prev = cur - dt.timedelta(hours=24)
    return prev, cur, end


def window_counts(tokens: DataFrame, end_time, align: str | None = "hour") -> DataFrame:
    """agg_token_count_window + join_full_align_counts: count_now / count_prev per token in one
    pass over the 48 h span (a token seen in either window is kept, the other count is 0)."""
    prev, cur, end = window_bounds(end_time, align)
    lo, mid, hi = (ntz(x) for x in (prev, cur, end))
    span = tokens.where((F.col("ts") >= lo) & (F.col("ts") < hi))
    is_now = F.col("ts") >= mid
    return span.groupBy(F.col("token").alias("word")).agg(
        F.count(F.when(is_now, 1)).alias("count_today"),
        F.count(F.when(~is_now, 1)).alias("count_prev"),
    )


def window_row_counts(tokens: DataFrame, end_time, align: str | None = "hour") -> DataFrame:
    """agg_window_row_counts: exploded rows in now / prev / total (diagnostics, fallback trigger)."""
    prev, cur, end = window_bounds(end_time, align)
    lo, mid, hi = (ntz(x) for x in (prev, cur, end))
    ts = F.col("ts")
    return tokens.agg(
        F.count(F.when((ts >= mid) & (ts < hi), 1)).alias("now_rows"),
        F.count(F.when((ts >= lo) & (ts < mid), 1)).alias("prev_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def growth(now_col="count_today", prev_col="count_prev"):
    """win_growth: (now - prev) / (prev + 1) in double."""
    return (F.col(now_col) - F.col(prev_col)).cast("double") / (F.col(prev_col) + 1).cast("double")


def trend_score(count_col="count_today", growth_col="growth", alpha=TRENDING_ALPHA, beta=TRENDING_BETA):
    """fn_trend_score: count^alpha * (1 + growth)^beta."""
    return F.pow(F.col(count_col).cast("double"), F.lit(float(alpha))) * \
        F.pow(F.lit(1.0) + F.col(growth_col), F.lit(float(beta)))


def finite(col: str):
    """fn_drop_non_finite: not NULL, not NaN, not +-inf."""
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def scored(counts: DataFrame, divisor: int, alpha=TRENDING_ALPHA, beta=TRENDING_BETA) -> DataFrame:
    """Growth, non-finite drop, flt_dynamic_min_count (count >= max(2, max // divisor)), score."""
    counts = materialize(counts)
    g = counts.withColumn("growth", growth())
    g = g.where(finite("growth"))
    max_count = counts.agg(F.max("count_today")).scalar()  # scalar subquery, run once
    floor = F.greatest(F.lit(2), F.coalesce(F.floor(max_count / divisor), F.lit(0)).cast("long"))
    g = g.where(F.col("count_today") >= floor)
    return g.withColumn("score", trend_score(alpha=alpha, beta=beta))


def top_lists(sc: DataFrame, n: int) -> DataFrame:
    """topk_trending + win_enumerate_rank: top-n by score, by count and by growth, ranked 1..n
    (ties by word), as one long table with a ``list`` column."""
    out = None
    for name, col in (("score", "score"), ("count", "count_today"), ("growth", "growth")):
        top = sc.orderBy(F.desc(col), F.asc("word")).limit(n)
        w = Window.orderBy(F.desc(col), F.asc("word"))
        part = top.withColumn("list", F.lit(name)).withColumn("rank", F.row_number().over(w))
        out = part if out is None else out.unionByName(part)
    return out


def trending_2days(df: DataFrame, end_time, top_n: int = 10, alpha=TRENDING_ALPHA, beta=TRENDING_BETA,
                   zone: str | None = TRENDING_ZONE, align: str | None = "hour", stopwords=None,
                   truncate_to_day: bool = False) -> DataFrame:
    """flow_trending_2days: now vs previous 24 h window, floor max//4, three top-N lists.

    ``truncate_to_day`` counts every text at the midnight of its local day, as the reference's job does when both of its
    analyses share one table (SURVEY Q7)."""
    prev, _, end = window_bounds(end_time, align)
    wide = (prev, end + dt.timedelta(days=1)) if truncate_to_day else (prev, end)
    toks = exploded_tokens(df, zone=zone, stopwords=stopwords, between=wide)
    if truncate_to_day:
        toks = toks.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    counts = window_counts(toks, end_time, align)
    return top_lists(scored(counts, 4, alpha, beta), top_n)


def latest_token_counts(texts: DataFrame, stopwords=None, most: int = 2) -> tuple[DataFrame | None, list]:
    """``date, word, n`` of the newest dates that hold a token, and the latest ``most`` of these dates, newest first.

    The dates of the table are found without looking at any text, one row per calendar day; then the newest ones are counted,
    twice as many each time, until enough hold a token.  The history is not tokenised.
    """
    dates = [r.date for r in texts.select("date").distinct().orderBy(F.desc("date")).collect()]
    counts, found, first, step = None, [], 0, most
    while first < len(dates) and len(found) < most:
        part = dates[first : first + step]
        raw = texts.where(F.col("date").between(part[-1], part[0])).select("date", F.explode(raw_tokens(F.col("text"))).alias("raw"))
        toks = raw.where(keep_token(F.col("raw"), stopwords)).select("date", clean_token(F.col("raw")).alias("word")).where(F.col("word") != "")
        some = materialize(toks.groupBy("date", "word").agg(F.count(F.lit(1)).alias("n")))
        counts = some if counts is None else counts.unionByName(some)
        found += sorted((r.date for r in some.select("date").distinct().collect()), reverse=True)
        first, step = first + step, step * 2
    return counts, found[:most]


def daily_counts(tokens: DataFrame) -> DataFrame:
    """agg_token_count_daily: count per (local date, token)."""
    return tokens.groupBy(F.to_date("ts").alias("date"), F.col("token").alias("word")).count()


def prev_day_lag(daily: DataFrame) -> DataFrame:
    """win_prev_day_lag for every date: ``date, word, count_today, count_prev`` against the previous date that is present.

    Sparse: a (date, token) row adds to its own date and, as the previous count, to the next present date, so a token missing
    on that date gets its one row with a count of 0 and no grid of dates and tokens is made.  The dates are numbered apart;
    there are no more of them than days in the history.
    """
    day = Window.orderBy("date")
    dates = daily.select("date").distinct().select("date", F.lead("date").over(day).alias("_next"))
    rows = daily.join(dates, "date")
    own = F.struct(F.col("date").alias("date"), F.col("count").alias("today"), F.lit(0).cast("long").alias("prev"))
    after = F.struct(F.col("_next").alias("date"), F.lit(0).cast("long").alias("today"), F.col("count").alias("prev"))
    both = rows.select("word", F.explode(F.array(own, after)).alias("_r")).where("_r.date is not null")
    return both.groupBy("_r.date", "word").agg(F.sum("_r.today").alias("count_today"), F.sum("_r.prev").alias("count_prev"))


def trending_daily(df: DataFrame, top_n: int = 20, alpha=TRENDING_ALPHA, beta=TRENDING_BETA,
                   zone: str | None = TRENDING_ZONE, stopwords=None, text_col: str = "content",
                   ts_col: str = "date") -> DataFrame:
    """flow_trending_daily: today = latest date present, yesterday = the previous present date
    (win_prev_day_lag); floor max//10; three top-N lists.

    A date is present when one of its texts yields a kept token.  Only the newest dates' texts are tokenised and counted,
    not the whole history.
    """
    ts = to_zone(ts_col, zone) if zone else F.col(ts_col).cast("timestamp_ntz")
    texts = df.select(F.to_date(ts).alias("date"), F.col(text_col).alias("text")).where(F.col("date").isNotNull())
    per, last2 = latest_token_counts(texts, stopwords)
    if per is None:  # no rows at all
        per, last2 = df.sparkSession.createDataFrame([], "date date, word string, n long"), []
    on = lambda i: F.sum(F.when(F.col("date") == F.lit(last2[i]), F.col("n")).otherwise(0)) if i < len(last2) else F.sum(F.lit(0))
    counts = per.where(F.col("date").isin(last2)).groupBy("word").agg(on(0).alias("count_today"), on(1).alias("count_prev"))
    return top_lists(scored(counts, 10, alpha, beta).drop("count_prev"), top_n)


def _seconds(freq: str) -> int:
    """Length of a bin such as '30 minutes' or '1 hour'."""
    n, unit = freq.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def token_bins(tokens: DataFrame, words: DataFrame, end_time, freq: str = "1 hour",
               align: str | None = "hour", closed: str = "left") -> DataFrame:
    """agg_token_bins (closed='left', [prev_start, end)) / agg_token_bins_right_closed
    ((prev_start, end], grid from prev_start + 1 s): counts of the given words per ``freq`` over a
    dense grid of bins, missing bins = 0.  The grid is (bins x the given words) only; the word
    table is joined, and sent to every task only if the optimizer finds it small."""
    prev, _, end = window_bounds(end_time, align)
    lo, hi = ntz(prev), ntz(end)
    step = _seconds(freq)
    if closed == "left":
        rows = tokens.where((F.col("ts") >= lo) & (F.col("ts") < hi))
        label, grid_end = prev, end - dt.timedelta(seconds=step)
    else:
        rows = tokens.where((F.col("ts") > lo) & (F.col("ts") <= hi))
        label, grid_end = prev + dt.timedelta(seconds=1), end
    rows = rows.join(words.select(F.col("word").alias("token")).distinct(), "token", "left_semi")
    number = F.floor(F.timestamp_diff("SECOND", lo, F.col("ts")) / step)
    binned = rows.groupBy(number.alias("_n"), F.col("token").alias("word")).count()
    # dense grid: every word gets every bin (an explode, no join); bin n starts n steps after the first
    count = int((grid_end - label).total_seconds() // step) + 1
    cells = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_n"))
    start = F.timestamp_add("SECOND", F.col("_n") * step, ntz(label))
    return cells.join(binned, ["_n", "word"], "left").select(start.alias("bin"), "word", F.coalesce("count", F.lit(0)).alias("count"))
