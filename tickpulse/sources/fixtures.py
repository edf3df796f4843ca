"""Reference-shaped tables derived from the shared test tables.

The engine's operators work on the social-post schemas (posts, replies,
chats, the all_content fact table, ...).  The test data is a set of generic
tables, so each builder here maps one of them onto a reference schema with a
fixed rule.  Every builder reads whole tables: its size grows with the data.
The same rules are written as SQL for the DuckDB oracle in
``tickpulse.plans.oracle_fixtures``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickpulse.constants import NEGATIVE, NEUTRAL, POSITIVE, STAT_SOURCES
from tickpulse.functions.timewin import epoch_seconds, to_epoch
from tickpulse.operators.common import spread

# FIXED VALUES: ticker dictionary used with the multilingual test documents
# (all are frequent words there; IT and AI are also common words)
TEST_TICKERS = ["THE", "CI", "DER", "DIE", "UND", "QUE", "LES", "IT", "AI", "ER"]

# FIXED VALUES: anchors inside the populated time range of the test data
RUN_TIME = dt.datetime(2024, 1, 15, 10, 0, 0)
TRENDING_END = dt.datetime(2024, 1, 10, 12, 0, 0)
SPLIT_EXISTING_BEFORE = dt.datetime(2024, 1, 20)
SPLIT_INCOMING_FROM = dt.datetime(2024, 1, 15)
# a conversation is anchored at event conv_id * CONV_STRIDE (spreads them over the month)
CONV_STRIDE = 97


# the tables that hold texts, and what deals their rows out
TEXT_TABLES = {"documents": ("doc_id",), "conversations": ("conv_id", "turn")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, *TEXT_TABLES[name]) if name in TEXT_TABLES else df


def _k(props="props"):
    return F.get_json_object(F.col(props), "$.k").cast("int")


def _source_of(idx):
    return F.element_at(F.array(*[F.lit(s) for s in STAT_SOURCES]), (idx % 6 + 1).cast("int"))


def _symbol_of(user_id):
    return F.concat(F.lit("S"), F.lpad((user_id % 50).cast("string"), 2, "0"))


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def event_times(spark, sf_dir) -> DataFrame:
    """(event_id, ts, epoch, k, user_id, event_type): time anchor for derived rows."""
    return events(spark, sf_dir).select(
        "event_id", "ts", epoch_seconds("ts").alias("epoch"), _k().alias("k"), "user_id", "event_type")


def all_content(spark, sf_dir) -> DataFrame:
    """api_sentiment_all_content rows: one per event."""
    e = events(spark, sf_dir)
    k = _k()
    sentiment = (F.when(F.col("event_type").isin("purchase", "signup"), F.lit(POSITIVE))
                 .when(F.col("event_type") == "error", F.lit(NEGATIVE))
                 .otherwise(F.lit(NEUTRAL)))
    return e.select(
        F.col("event_id").alias("id"),
        epoch_seconds("ts").alias("timestamp"),
        _source_of(k).alias("source"),
        F.lit(None).cast("string").alias("title"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(_symbol_of(F.col("user_id"))).alias("symbol"),
        F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string")).alias("content"),
        sentiment.alias("sentiment"),
    )


def posts(spark, sf_dir) -> DataFrame:
    """Unified posts (platform, post_id, content, ts, timestamp) from documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = event_times(spark, sf_dir).select("event_id", "ts", "epoch")
    j = d.join(t, d.doc_id * 5 == t.event_id, "inner")
    return j.select(
        _source_of(F.col("doc_id")).alias("platform"),
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("text").alias("content"),
        F.col("ts"),
        F.col("epoch").alias("timestamp"),
    )


def _anchored(c: DataFrame, t: DataFrame) -> DataFrame:
    """Every conversation row with its anchor event; anchors beyond the last event wrap round, without any event the times are NULL."""
    last = t.agg(F.max("event_id")).scalar()
    c = c.withColumn("anchor", F.pmod(F.col("conv_id") * CONV_STRIDE, last + 1))
    return c.join(t, c.anchor == t.event_id, "left")


def fb_post(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn = 0")
    t = event_times(spark, sf_dir).select("event_id", "epoch")
    return _anchored(c, t).select(
        F.col("conv_id").cast("string").alias("post_id"),
        F.col("text").alias("content"),
        F.col("epoch").alias("timestamp"),
    )


def fb_reply(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn > 0")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("reply_id"),
        F.col("conv_id").cast("string").alias("post_id"),
        F.col("text").alias("rely_content"),
    )


def _tags_json(k, user_id):
    one = F.concat(F.lit('{"symbol":"'), _symbol_of(user_id), F.lit('"}'))
    two = F.concat(F.lit('{"symbol":"'), _symbol_of(user_id + 7), F.lit('"}'))
    return (F.when(k % 10 == 0, F.lit("[]"))
            .when(k % 3 == 0, F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")))
            .otherwise(F.concat(F.lit("["), one, F.lit("]"))))


def fireant_posts(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = event_times(spark, sf_dir)
    j = d.join(t, d.doc_id * 5 == t.event_id, "inner")
    return j.select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("text").alias("original_content"),
        F.col("ts").alias("date"),
        _tags_json(F.col("k"), F.col("user_id")).alias("tagged_symbols"),
    )


def zalo_chat(spark, sf_dir) -> DataFrame:
    """All turns of a conversation share the second of its anchor event."""
    c = table(spark, sf_dir, "conversations")
    t = event_times(spark, sf_dir).select("event_id", "epoch")
    return _anchored(c, t).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), F.lit("NA"))
        .otherwise(F.col("text")).alias("content"),
        F.col("epoch").alias("date"),
    )


def yt_post(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = event_times(spark, sf_dir).select("event_id", "ts")
    return d.join(t, d.doc_id * 5 + 1 == t.event_id, "inner").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("text").alias("post_content"),
        F.col("ts").alias("post_at"),
    )


def youtuber_advice(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    t = event_times(spark, sf_dir).select("event_id", "epoch", "user_id")
    return _anchored(c, t).select(
        (F.col("epoch") + F.col("turn")).alias("timestamp"),
        _symbol_of(F.col("user_id")).alias("symbol"),
        F.col("text").alias("advise"),
        F.concat(F.lit("yt"), F.col("conv_id").cast("string")).alias("source"),
    )


def tickers(spark, sf_dir=None) -> DataFrame:
    """The ticker dimension for the test documents."""
    return spark.createDataFrame([(t,) for t in TEST_TICKERS], "symbol string")


def institution_profiles(spark, sf_dir) -> DataFrame:
    """Raw ticker dimension: mixed case, with blanks (needs upper + distinct)."""
    e = events(spark, sf_dir)
    k = _k()
    sym = F.when(k % 10 == 0, F.lit("")).when(k % 2 == 0, F.lower(_symbol_of(F.col("user_id")))) \
        .otherwise(_symbol_of(F.col("user_id")))
    return e.select(sym.alias("symbol"))


def rumors(spark, sf_dir) -> DataFrame:
    """rumor table (id, timestamp, symbol, content, sentiment, source) from user turns."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    t = event_times(spark, sf_dir).select("event_id", "epoch", "user_id", "k")
    return _anchored(c, t).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        (F.col("epoch") + F.col("turn")).alias("timestamp"),
        F.when(F.col("k") % 10 == 0, F.lit(None).cast("string"))
        .when(F.col("k") % 5 == 1, F.concat(F.lit(" "), F.lower(_symbol_of(F.col("user_id"))), F.lit("-vn@hose ")))
        .otherwise(_symbol_of(F.col("user_id"))).alias("symbol"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("sentiment"),
        F.lit("zalo_chat").alias("source"),
    )


def rumor_analyst(spark, sf_dir) -> DataFrame:
    """Rumors already rewritten: those of the first half of the month."""
    r = rumors(spark, sf_dir).where(F.col("timestamp") < F.lit(to_epoch(SPLIT_INCOMING_FROM)))
    return r.select(
        F.col("content").alias("original_content"),
        F.col("content").alias("rewritten_content"),
        "symbol", "sentiment", "source", "timestamp",
        F.col("id").alias("processed_from_rumor_id"),
    )


def calendar_raw(spark, sf_dir) -> DataFrame:
    """Scraped calendar rows: the date text only on the first row of each day."""
    e = events(spark, sf_dir)
    k = _k()
    return e.select(
        F.floor(epoch_seconds("ts") / 604800).cast("bigint").alias("page_id"),
        F.col("event_id").alias("row_idx"),
        F.col("ts"),
        k.alias("k"),
        "event_type", "user_id", "value",
    ).selectExpr(
        "page_id", "row_idx",
        "case when row_idx = min(row_idx) over (partition by page_id, to_date(ts)) "
        "then date_format(ts, 'EEE MMM d') else '' end as date",
        "case when k % 2 = 1 then '' else date_format(ts, 'HH:mm') end as time",
        "case when user_id % 3 = 0 then 'USD' when user_id % 3 = 1 then 'EUR' else 'JPY' end as currency",
        "case when k % 3 = 0 then 'High' when k % 3 = 1 then 'Medium' else 'Low' end as impact",
        "case when event_type = 'view' then '' else concat(event_type, ' index ', cast(user_id as string)) end as event",
        "cast(value as string) as actual",
        "cast(cast(floor(value * 90) as bigint) as string) as forecast",
        "cast(cast(floor(value * 110) as bigint) as string) as previous",
    )


def labelled(spark, sf_dir) -> DataFrame:
    """Labelled training text (text, label, stock_code, has_stock)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "inner")
    return j.select(
        "doc_id",
        F.col("text"),
        F.when(F.col("toxic") == 1, F.lit("negative")).when(F.col("quality") == 1, F.lit("positive"))
        .otherwise(F.lit("neutral")).alias("label"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(_symbol_of(F.col("doc_id"))).alias("stock_code"),
        (F.col("doc_id") % 7 != 0).alias("has_stock"),
    )


def predictions(spark, sf_dir) -> DataFrame:
    """Classifier output (true_label, pred_label, confidence) over labelled documents."""
    lab = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id")
    j = lab.join(d, "doc_id", "inner")
    names = F.array(*[F.lit(x) for x in ["negative", "neutral", "positive"]])
    true_idx = F.col("quality") * 2
    pred_idx = F.when(F.col("doc_id") % 5 == 0, F.lit(1)).otherwise((1 - F.col("toxic")) * 2)
    return j.select(
        "doc_id",
        F.element_at(names, (true_idx + 1).cast("int")).alias("true_label"),
        F.element_at(names, (pred_idx + 1).cast("int")).alias("pred_label"),
        ((F.col("doc_id") % 101) / F.lit(100.0)).alias("confidence"),
    )


def rewrite_pairs(spark, sf_dir) -> DataFrame:
    """(user turn, following assistant turn) as (original, rewritten)."""
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("original"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                              F.col("text").alias("rewritten"))
    return u.join(a, ["conv_id", "turn"], "inner").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"), "original", "rewritten")
