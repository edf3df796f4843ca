"""Join operators (inventory 2.4): the "not yet processed" anti-joins, the
reply-to-post join, tag explosion and dictionary membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickpulse.constants import COMMON_WORDS
from tickpulse.functions.text import strip, stripped_length
from tickpulse.functions.tickers import candidates, context_ok, raw_runs
from tickpulse.operators.common import content_keys


def anti_processed_content(posts: DataFrame, done: DataFrame) -> DataFrame:
    """join_anti_processed_content: posts with no processed row of the same content and platform.

    Both sides are keyed by the platform and two 64-bit hashes of the text, so no text is shuffled as a
    key and the processed side travels as hashes only, one row per distinct text.  A NULL platform or
    content never matches.
    """
    d = done.where(F.col("content").isNotNull()).select(F.col("source").alias("_p"), *content_keys("content"))
    d = d.distinct().select("_p", F.col("_k1").alias("_d1"), F.col("_k2").alias("_d2"))
    k1, k2 = content_keys("content")
    p = posts.select("*", k1, k2)
    cond = (p["platform"] == d["_p"]) & (p["_k1"] == d["_d1"]) & (p["_k2"] == d["_d2"]) & p["content"].isNotNull()
    return p.join(d, cond, "left_anti").drop("_k1", "_k2")


def anti_processed_reply(replies: DataFrame, summary: DataFrame) -> DataFrame:
    """join_anti_processed_reply: replies without a reply_summary row (ids compared as text)."""
    s = summary.select(F.col("reply_id").cast("string").alias("_rid")).distinct()
    return replies.join(s, replies["reply_id"].cast("string") == s["_rid"], "left_anti")


def anti_processed_rumor(rumors: DataFrame, analyst: DataFrame) -> DataFrame:
    """join_anti_processed_rumor: rumors never rewritten (a NULL link never matches)."""
    a = analyst.select(F.col("processed_from_rumor_id").alias("_rid")).where("_rid is not null").distinct()
    return rumors.join(a, rumors["id"] == a["_rid"], "left_anti")


def reply_with_post(replies: DataFrame, posts: DataFrame) -> DataFrame:
    """join_reply_post: each reply inherits its post's timestamp (inner join)."""
    p = posts.select("post_id", "timestamp")
    return replies.join(p, "post_id", "inner")


def explode_tags(fireant: DataFrame) -> DataFrame:
    """explode_tagged_symbols: one row per tag; posts without tags vanish."""
    tags = F.from_json("tagged_symbols", "array<struct<symbol:string>>")
    return fireant.select("post_id", F.explode(tags).alias("tag")).select("post_id", F.col("tag.symbol").alias("symbol"))


def dictionary_hits(texts: DataFrame, key: str, text_col: str, tickers: DataFrame) -> DataFrame:
    """join_ticker_dictionary: (key, code) for every candidate code found in the dictionary.

    Candidates are exploded per row and joined; whether the dictionary is small enough to be sent to
    every task is left to the optimizer's own size check.
    """
    c = texts.select(key, F.explode(candidates(F.col(text_col))).alias("code"))
    dim = tickers.select(F.col("symbol").alias("code")).distinct()
    return c.join(dim, "code", "inner").select(key, "code")


def codes_by_table(texts: DataFrame, key: str, text_col: str, tickers: DataFrame, col: str = "symbol") -> DataFrame:
    """fn_ticker_rules / fn_extract_codes with a dictionary that stays a table: ``key, codes`` of every text, as ``rule_codes`` gives them.

    Candidates are exploded in the task that reads the text and looked up; (key, code) rows are gathered per text with
    partial aggregation, so no text is shuffled.  Only the symbols that a candidate can equal are sent to the tasks: words of
    two to four letters A-Z, of which there are 475,254 at most, whatever else the dictionary lists.
    """
    t = F.col(text_col)
    code = F.upper(strip(F.col(col)))
    dim = F.broadcast(tickers.select(code.alias("code")).where(F.col("code").rlike("^[A-Z]{2,4}$")).distinct())
    rows = texts.where(stripped_length(t) >= 5).select(key, t.alias("_t"), F.explode(candidates(t)).alias("code"))
    rows = rows.join(dim, "code", "left_semi")
    plain = ~F.col("code").isin(*COMMON_WORDS)
    named = rows.where(plain | (F.array_contains(raw_runs("_t"), F.col("code")) & context_ok("_t", F.col("code"))))
    per = named.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return texts.select(key).join(per, key, "left").select(key, F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def drop_stopwords(tokens: DataFrame, stopwords: DataFrame, token_col: str = "token") -> DataFrame:
    """join_stopword_anti: remove stopword tokens with an anti join."""
    sw = stopwords.select(F.col("word").alias(token_col)).distinct()
    return tokens.join(sw, token_col, "left_anti")
