"""Composite dataflows (inventory 2.11): each is one DataFrame plan built from
the operators, with every run parameter (run time, zone, dictionary, scorer)
explicit so that results are repeatable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickpulse.constants import DEFAULT_CONFIDENCE, NEUTRAL, YT_WINDOW_WORDS
from tickpulse.functions.rumor_rules import accept_rewrite, rewrite_text, rumor_pattern
from tickpulse.functions.sentences import (important_sentences, smart_summary, split_by_capital,
                                           split_sentences)
from tickpulse.functions.text import nfc, spaced_words, stripped_length, summary_clean, validate_symbol, words
from tickpulse.functions.tickers import TickerDictionary, extract_codes, symbols_csv
from tickpulse.functions.timewin import normalize_calendar_date
from tickpulse.operators import joins, rollup
from tickpulse.operators.common import content_keys, materialize
from tickpulse.operators.fill import carry_down
from tickpulse.operators.sentiment import transform_sentiment
from tickpulse.sources import unified

# ---------------------------------------------------------------- posts


def short_post_rows(posts: DataFrame) -> DataFrame:
    """flt_short_text_route: posts under 10 stripped characters -> one neutral row, raw content."""
    p = posts.where(F.col("content").isNull() | (stripped_length("content") < 10))
    return p.select("timestamp", F.col("platform").alias("source"), F.lit(None).cast("string").alias("title"),
                    F.lit(None).cast("string").alias("symbol"), "content", F.lit(NEUTRAL).alias("sentiment"))


def post_rows(posts: DataFrame, dictionary: TickerDictionary, scorer=None) -> DataFrame:
    """flow_process_posts rows in one pass over the posts: a short post (under 10 stripped
    characters) gives one neutral row with its raw content; a longer post gives one row per
    found ticker with its important sentence, or one row with the whole (NFC) text when it
    names none; sentiment is scored on that sentence, or on the whole text when it is ''."""
    short = F.col("content").isNull() | (stripped_length("content") < 10)
    p = posts.withColumn("_short", short)
    p = p.withColumn("_text", F.when(F.col("_short"), F.col("content")).otherwise(nfc("content")))
    p = p.withColumn("_codes", F.when(F.col("_short"), F.array().cast("array<string>"))
                     .otherwise(extract_codes(F.col("_text"), dictionary)))
    one = F.array(F.struct(F.lit(None).cast("string").alias("symbol"), F.col("_text").alias("sentence")))
    items = F.when(F.col("_short") | (F.size("_codes") == 0), one) \
        .otherwise(important_sentences(split_sentences("_text"), F.col("_codes")))
    p = p.select("*", F.explode(items).alias("_pair"))
    p = p.withColumn("symbol", F.col("_pair.symbol")).withColumn("_sentence", F.col("_pair.sentence"))
    p = p.withColumn("_sent_text", F.when(F.col("_sentence") != "", F.col("_sentence")).otherwise(F.col("_text")))
    p = transform_sentiment(p, "_sent_text", scorer, normalized=True)
    sentiment = F.when(F.col("_short"), F.lit(NEUTRAL)).otherwise(F.col("sentiment"))
    return p.select("timestamp", F.col("platform").alias("source"), F.lit(None).cast("string").alias("title"),
                    "symbol", F.col("_sentence").alias("content"), sentiment.alias("sentiment"))


def process_posts(posts: DataFrame, dictionary: TickerDictionary, done: DataFrame | None = None, scorer=None,
                  since_epoch: int | None = None) -> DataFrame:
    """flow_process_posts: unprocessed posts -> all_content rows, one per (timestamp, symbol, content)."""
    p = posts.where(F.col("content").isNotNull())
    if since_epoch is not None:
        p = unified.posts_since(p, since_epoch, 0)
    if done is not None:
        p = joins.anti_processed_content(p, done)
    return first_rows(post_rows(p, dictionary, scorer))


def run_posts(posts: DataFrame, state: str, dictionary: TickerDictionary, scorer=None, since_epoch: int | None = None, buckets: int = 64) -> DataFrame:
    """flow_process_posts as a scheduled job: posts the ledger does not hold are processed, their rows are merged into the
    committed all_content table, and then they enter the ledger.  Returns the rows of the run.

    ``state`` is the job's folder; ``buckets`` of its ledger and table is settled by the first run.  A run that fails after its merge is repeated without effect on the table, because rows
    that are there already are not inserted again.
    """
    from tickpulse.session import scratch_path
    from tickpulse.tables.ledger import Ledger

    spark = posts.sparkSession
    ledger, table = Ledger(spark, f"{state}/processed", buckets), content_table(spark, state, buckets)
    fresh = posts if since_epoch is None else unified.posts_since(posts, since_epoch, 0)
    path = scratch_path(spark, "fresh-posts")  # read for the rows and for the ledger: the anti-join runs once
    ledger.unprocessed(fresh.select("platform", "post_id", "content", "timestamp").where(F.col("content").isNotNull())).write.parquet(path)
    fresh = spark.read.parquet(path)
    staged = scratch_path(spark, "post-rows")
    process_posts(fresh, dictionary, scorer=scorer).write.parquet(staged)
    rows = spark.read.parquet(staged)
    table.merge(rows.withColumn("symbol_key", F.coalesce("symbol", F.lit(""))), "ignore", ["source", "sentiment"])
    ledger.add(fresh)
    return rows


def content_table(spark, state: str, buckets: int = 64):
    """The committed all_content table of a job; a row without a symbol is one key like any other (``symbol_key``)."""
    from tickpulse.tables.bucket_table import BucketTable

    try:
        return BucketTable(spark, f"{state}/all_content")
    except FileNotFoundError:
        schema = spark.createDataFrame([], "timestamp long, source string, title string, symbol string, content string, sentiment string, symbol_key string").schema
        return BucketTable.create(spark, f"{state}/all_content", schema, ["timestamp", "symbol_key", "content"], buckets)


def first_rows(rows: DataFrame) -> DataFrame:
    """One row per (timestamp, symbol, content): the first by (source, sentiment).

    The text is not a shuffle key: two 64-bit hashes stand for it, and repeated rows combine in
    every task before the shuffle.
    """
    rest = F.struct("source", "sentiment", "title", "content")
    best = rows.groupBy("timestamp", "symbol", *content_keys("content")).agg(F.min(rest).alias("row"))
    return best.select("timestamp", "row.source", "row.title", "symbol", "row.content", "row.sentiment")


def short_reply_rows(replies: DataFrame) -> DataFrame:
    """flt_short_reply_route: replies under 5 stripped characters -> neutral row, no stock, no sentence."""
    r = replies.where(F.col("rely_content").isNull() | (stripped_length("rely_content") < 5))
    return r.select("reply_id", "post_id", F.lit(None).cast("string").alias("stock_id"),
                    F.lit(None).cast("string").alias("cau_quan_trong"), F.lit(NEUTRAL).alias("cam_xuc"), "timestamp")


def process_replies(replies: DataFrame, posts: DataFrame, dictionary: TickerDictionary,
                    summary: DataFrame | None = None, scorer=None) -> DataFrame:
    """flow_process_replies: every unprocessed reply of every post in one pass: a short reply or one
    without a ticker gives one neutral row, any other one row per ticker with its important sentence."""
    r = joins.reply_with_post(replies, posts)
    if summary is not None:
        r = joins.anti_processed_reply(r, summary)
    short = F.col("rely_content").isNull() | (stripped_length("rely_content") < 5)
    r = r.withColumn("_short", short).withColumn("_text", F.when(~short, nfc("rely_content")))
    r = r.withColumn("_codes", F.when(F.col("_short"), F.array().cast("array<string>"))
                     .otherwise(extract_codes(F.col("_text"), dictionary)))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("sentence")))
    items = F.when(F.size("_codes") == 0, nothing).otherwise(important_sentences(split_sentences("_text"), F.col("_codes")))
    r = r.select("*", F.explode(items).alias("_pair"))
    r = r.withColumn("stock_id", F.col("_pair.symbol")).withColumn("cau_quan_trong", F.col("_pair.sentence"))
    r = transform_sentiment(r, "cau_quan_trong", scorer, normalized=True)
    has = F.coalesce(F.col("cau_quan_trong") != "", F.lit(False))
    return r.select("reply_id", "post_id", "stock_id", "cau_quan_trong",
                    F.when(has, F.col("sentiment")).otherwise(F.lit(NEUTRAL)).alias("cam_xuc"), "timestamp",
                    F.when(has, F.col("confidence")).otherwise(F.lit(DEFAULT_CONFIDENCE)).alias("confidence_score"))


# ---------------------------------------------------------------- roll-ups


def stock_sentiment_job(all_content: DataFrame, run_time) -> DataFrame:
    """flow_stock_sentiment: 24h / week / month roll-ups (row_num NULL) plus the ranked 24h top-10.

    The finished roll-up (one row per symbol and interval) is written once, so the facts are read once.
    """
    ss = materialize(rollup.stock_sentiment_all_intervals(all_content, run_time))
    top = rollup.top_stocks(ss, "24h").withColumnRenamed("updated_at", "timestamp")
    return ss.withColumn("row_num", F.lit(None).cast("int")).unionByName(top)


# ---------------------------------------------------------------- rumors


def detect_rumors(messages: DataFrame, dictionary: TickerDictionary, patterns=None) -> DataFrame:
    """flow_detect_rumors: cue pattern, symbols (zalo: found in the text; fireant: the tags),
    keep matched rows, one row per content (first by source, date, id)."""
    m = messages.withColumn("matched_keyword", rumor_pattern("content", patterns))
    m = m.where(F.col("matched_keyword").isNotNull())
    m = m.withColumn("symbol", F.when(F.col("source") == "zalo_chat", symbols_csv("content", dictionary))
                     .otherwise(F.col("symbols")))
    return dedup_first_content(m.select("id", "content", "symbol", "source", "date", "matched_keyword"))


def dedup_first_content(df: DataFrame) -> DataFrame:
    """dedup_keep_first_content: one row per content, the first by (source order, date, id).

    Grouped on two hashes of the content with map-side partial minima, so a heavily repeated
    content is combined in every task and no text is a shuffle key.
    """
    rank = F.when(F.col("source") == "fireant_posts", 0).otherwise(1)
    best = df.groupBy(*content_keys("content")).agg(
        F.min(F.struct(rank.alias("_r"), "date", "id", *[c for c in df.columns if c not in ("date", "id")])).alias("row"))
    return best.select(*[F.col(f"row.{c}").alias(c) for c in df.columns])


def rumors_for_load(detected: DataFrame) -> DataFrame:
    """sink_rumor_append rows: (timestamp, symbol, content, NULL sentiment, source)."""
    return detected.select(F.col("date").alias("timestamp"), "symbol", "content",
                           F.lit(None).cast("string").alias("sentiment"), "source")


def rewrite_rumors(rumors: DataFrame, analyst: DataFrame | None = None,
                   since_epoch: int | None = None, rewriter=None) -> DataFrame:
    """flow_rewrite_rumors: queue -> length gate -> rewrite -> accept -> validate symbol -> rows
    to append to rumor_analyst.  ``rewriter`` maps a text Column to a rewritten Column
    (default: the rule-based rewriter used when no generation model is loaded)."""
    q = rumors
    if analyst is not None:
        q = joins.anti_processed_rumor(q, analyst)
    if since_epoch is not None:
        q = q.where(F.col("timestamp") >= since_epoch)
    q = q.where(F.col("content").isNotNull() & (stripped_length("content") >= 3))
    rw = (rewriter or rewrite_text)(F.col("content"))
    out = q.withColumn("_rw", accept_rewrite(rw, F.col("content")))
    return out.select(
        F.col("content").alias("original_content"), F.col("_rw").alias("rewritten_content"),
        validate_symbol("symbol").alias("symbol"), "sentiment", "source", "timestamp",
        F.col("id").alias("processed_from_rumor_id"))


# ---------------------------------------------------------------- YouTube mentions


def yt_mentions(posts: DataFrame, tickers: list[str], max_words: int = YT_WINDOW_WORDS, whole_word: bool = False) -> DataFrame:
    """flow_yt_mentions: for every case-sensitive substring hit of a ticker (longest tickers first,
    non-overlapping): the +-20-word window, split at capitals, and for each not-yet-used sentence
    holding the ticker a (sentence, previous + sentence + next) row; neighbours become used.

    A ticker inside a longer word counts too, as in the reference; ``whole_word`` takes whole words only (SURVEY Q14).

    Hits cannot span whitespace, so they are found word by word and the word index is exact.
    All work happens inside the post's row (array functions on its word list and on
    <= 41-word windows); only the final mentions are exploded into rows.
    """
    if not tickers:
        return posts.sparkSession.createDataFrame(
            [], "post_id string, post_ticker string, post_sentence string, context string, post_at timestamp_ntz")
    import re

    from tickpulse.functions.sentences import let

    alternation = "(" + "|".join(re.escape(t) for t in sorted(tickers, key=len, reverse=True)) + ")"
    if whole_word:
        alternation = r"(?<![\p{L}\p{N}_])" + alternation + r"(?![\p{L}\p{N}_])"
    item_type = "array<struct<tk:string,sentence:string,context:string>>"

    def mentions_in_window(sents, tk):
        init = F.struct(F.lit(-1).alias("used"), F.array().cast(item_type).alias("out"))  # used: last sentence taken

        def step(acc, j):
            cur = F.element_at(sents, j + 1)
            prev = F.when(j > 0, F.element_at(sents, F.greatest(j, F.lit(1))))
            nxt = F.when(j < F.size(sents) - 1, F.element_at(sents, F.least(j + 2, F.size(sents))))
            named = F.array_contains(F.regexp_extract_all(cur, F.lit(alternation), 1), tk) if whole_word else F.contains(cur, tk)
            skip = (j <= acc["used"]) | ~named
            item = F.struct(tk.alias("tk"), cur.alias("sentence"), F.concat_ws(" ", prev, cur, nxt).alias("context"))
            new = F.struct((j + 1).alias("used"), F.array_append(acc["out"], item).alias("out"))
            return F.when(skip, acc).otherwise(new)

        return F.aggregate(F.sequence(F.lit(0), F.size(sents) - 1), init, step)["out"]

    def per_post(ws):
        n = F.size(ws)
        hits = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("i"), F.regexp_extract_all(
            w, F.lit(alternation), 1).alias("tks"))), lambda h: F.size(h["tks"]) > 0)

        def per_hit(h):
            lo = F.greatest(h["i"] - max_words, F.lit(0))
            hi = F.least(n, h["i"] + max_words + 1)
            window = F.array_join(F.slice(ws, lo + 1, hi - lo), " ")
            return let(split_by_capital(window), lambda sents: F.flatten(
                F.transform(h["tks"], lambda tk: mentions_in_window(sents, tk))))

        return F.flatten(F.transform(hits, per_hit))

    p = posts.where(F.col("post_content").rlike(alternation))
    m = p.select("post_id", "post_at", F.explode(let(words("post_content"), per_post)).alias("m"))
    return m.select("post_id", F.col("m.tk").alias("post_ticker"), F.col("m.sentence").alias("post_sentence"),
                    F.col("m.context").alias("context"), "post_at")


def advice_rows(mentions: DataFrame) -> DataFrame:
    """flow_yt_job load rows: (timestamp, symbol, advise, source = post_id)."""
    from tickpulse.functions.timewin import epoch_seconds

    return mentions.select(epoch_seconds("post_at").alias("timestamp"), F.col("post_ticker").alias("symbol"),
                           F.col("context").alias("advise"), F.col("post_id").alias("source"))


# ---------------------------------------------------------------- calendar


def calendar_headers(raw: DataFrame) -> DataFrame:
    """win_ffill_date: ``_hdr``, the last date header of the page at or above the row, and ``grp``, its number (0: none yet)."""
    has_date = F.col("date").isNotNull() & (F.regexp_replace("date", r"(?U)\s", "") != "")
    return carry_down(raw, ["page_id"], "row_idx", {"_hdr": F.when(has_date, F.col("date"))}, {"grp": has_date})


def calendar_times(rows: DataFrame) -> DataFrame:
    """win_ffill_time: a blank time takes the last time of its date group ('' when there is none)."""
    t = F.nullif(F.regexp_replace("time", r"(?U)^\s+|\s+$", ""), F.lit(""))
    out = carry_down(rows, ["page_id", "grp"], "row_idx", {"event_time": t})
    return out.withColumn("event_time", F.coalesce("event_time", F.lit("")))


def calendar_events(raw: DataFrame, base_date) -> DataFrame:
    """flow_calendar (flat): date headers fill down within a page (win_ffill_date), rows without
    an event title are dropped (flt_event_present), blank times take the last time of the same
    date group (win_ffill_time), dates are normalised (fn_normalize_date); rows before the first
    header or under an empty date are dropped."""
    # both fills in one pass: a time counts if it stands at or below the header that the row is under
    has_date = F.col("date").isNotNull() & (F.regexp_replace("date", r"(?U)\s", "") != "")
    present = F.regexp_replace("event", r"(?U)^\s+|\s+$", "") != ""
    time = F.nullif(F.regexp_replace("time", r"(?U)^\s+|\s+$", ""), F.lit(""))
    # a date is normalised where its header stands, not on every row below it
    day = normalize_calendar_date(F.col("date"), base_date)
    r = carry_down(raw, ["page_id"], "row_idx", {
        "_head": F.when(has_date, F.struct(F.col("row_idx").alias("at"), day.alias("day"))),
        "_time": F.when(present & time.isNotNull(), F.struct(F.col("row_idx").alias("at"), time.alias("text")))}, {"grp": has_date})
    r = r.where((F.col("grp") > 0) & present)
    r = r.withColumn("event_time", F.when(F.col("_time.at") >= F.col("_head.at"), F.col("_time.text")).otherwise(F.lit("")))
    r = r.withColumn("event_date", F.col("_head.day"))
    r = r.where(F.col("event_date") != "")
    return r.select("page_id", "grp", "row_idx", "event_date", "event_time", "currency", "impact", "event", "actual",
                    "forecast", "previous")


def nest_events(flat: DataFrame) -> DataFrame:
    """fn_nest_events: one row per (page, date group) with its events in row order."""
    ev = F.struct("row_idx", F.col("event_time").alias("time"), "currency", "impact", "event", "actual", "forecast",
                  "previous")
    g = flat.groupBy("page_id", "grp", "event_date").agg(F.array_sort(F.collect_list(ev)).alias("events"))
    return g.select(F.col("event_date").alias("date"), "events", "page_id", "grp")


def unnest_events(nested: DataFrame) -> DataFrame:
    """fn_unnest_events: back to one row per event."""
    e = nested.select("date", "page_id", "grp", F.explode("events").alias("e"))
    return e.select(F.col("date").alias("event_date"), F.col("e.time").alias("event_time"), "e.currency", "e.impact",
                    "e.event", "e.actual", "e.forecast", "e.previous", "e.row_idx", "page_id", "grp")


CALENDAR_KEY = ["event_date", "event_time", "event"]
CALENDAR_COLUMNS = ["event_date", "event_time", "currency", "impact", "event", "actual", "forecast", "previous"]


def calendar_upsert(existing: DataFrame, flat: DataFrame, path: str) -> DataFrame:
    """sink_calendar_upsert: key (event_date, event_time, event), written and committed at ``path``; the last row of the batch wins."""
    from tickpulse.tables.bucket_table import BucketTable

    table = BucketTable.of(existing.select(*CALENDAR_COLUMNS), path, CALENDAR_KEY)
    table.merge(flat, "update", ["page_id", "row_idx"])
    return table.read()


# ---------------------------------------------------------------- summaries


def summarize(df: DataFrame, text_col: str, max_length: int = 150, summarizer=None) -> DataFrame:
    """flow_summarize: clean; fewer than 20 words or no model -> extractive summary; otherwise the
    model's summary post-processed.  ``summarizer`` maps a cleaned-text Column to a summary Column."""
    from tickpulse.functions.sentences import summary_post_process

    d = df.withColumn("_clean", summary_clean(F.col(text_col)))
    extractive = smart_summary(F.col("_clean"), max_length, cleaned=True, spaced=True)
    if summarizer is None:
        return d.withColumn("summary", extractive).drop("_clean")
    model = summary_post_process(summarizer(F.col("_clean")), F.col("_clean"))
    return d.withColumn("summary", F.when(spaced_words("_clean") < 20, extractive).otherwise(model)).drop("_clean")

