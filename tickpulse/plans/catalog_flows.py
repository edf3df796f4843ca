"""Registered queries: composite dataflows (inventory 2.11) and streams (2.12)."""

import datetime as dt

from pyspark.sql import functions as F

from tickpulse.functions.timewin import ntz
from tickpulse.operators import trending as tr
from tickpulse.plans import oracle_text as ot
from tickpulse.plans.catalog_relational import TREND_FIXTURES, TREND_UNION_SQL, trend_union
from tickpulse.plans.oracle_fixtures import with_fixtures
from tickpulse.plans.registry import register
from tickpulse.sources import fixtures as fx

END = fx.TRENDING_END  # Bangkok wall clock
PREV, CUR, _END = tr.window_bounds(END, "hour")
# FIXED VALUES: a stopword table for the multilingual test text
TEST_STOPWORDS = ["the", "of", "and", "to", "de", "la", "und", "die", "que", "el"]


def _ts(d: dt.datetime) -> str:
    return f"TIMESTAMP '{d.isoformat(sep=' ')}'"


TOK_CTE = [("tu", TREND_UNION_SQL),
           ("tok", f"select date + interval 7 hour as ts, unnest({ot.tokenize('content')}) as token from tu "
                   f"where date is not null")]
CNT_SQL = f"""select token as word, count(*) filter (where ts >= {_ts(CUR)}) as count_today,
        count(*) filter (where ts < {_ts(CUR)}) as count_prev
    from tok where ts >= {_ts(PREV)} and ts < {_ts(_END)} group by token"""


def _scored_sql(divisor: int, alpha=0.5, beta=1.0, src="cnt") -> str:
    return f"""select word, count_today, count_prev, g as growth,
        pow(cast(count_today as double), {alpha}) * pow(1.0 + g, {beta}) as score
    from (select *, cast(count_today - count_prev as double) / cast(count_prev + 1 as double) as g from {src})
    where count_today >= greatest(2, coalesce((select max(count_today) from {src}) // {divisor}, 0))"""


def _lists_sql(src: str, n: int, cols: str) -> str:
    parts = []
    for name, col in (("score", "score"), ("count", "count_today"), ("growth", "growth")):
        parts.append(f"""select * from (select {cols}, '{name}' as list,
            row_number() over (order by {col} desc, word) as rank from {src} order by {col} desc, word limit {n})""")
    return " union all ".join(parts)


def _round(df, cols=("growth", "score")):
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.round(c, 9))
    return df


R9 = "round(growth, 9) as growth, round(score, 9) as score"


def _toks(spark, sf):
    return tr.exploded_tokens(trend_union(spark, sf))


def _span_toks(spark, sf):
    """The tokens of both windows, written once for a query that counts them more than once."""
    from tickpulse.session import scratch_path

    path = scratch_path(spark, "span-tokens")
    tr.exploded_tokens(trend_union(spark, sf), between=(PREV, _END)).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _counts(spark, sf):
    return tr.window_counts(_toks(spark, sf), END)


@register("agg_token_count_window", with_fixtures(CNT_SQL, *TREND_FIXTURES, extra=TOK_CTE))
def q_agg_token_count_window(spark, sf):
    return _counts(spark, sf)


@register("join_full_align_counts", with_fixtures(
    f"""select coalesce(a.word, b.word) as word, coalesce(a.n, 0) as count_today, coalesce(b.n, 0) as count_prev
    from (select token as word, count(*) as n from tok where ts >= {_ts(CUR)} and ts < {_ts(_END)} group by 1) a
    full outer join (select token as word, count(*) as n from tok where ts >= {_ts(PREV)} and ts < {_ts(CUR)} group by 1) b
    on a.word = b.word""", *TREND_FIXTURES, extra=TOK_CTE))
def q_join_full_align_counts(spark, sf):
    t = _toks(spark, sf)
    now = t.where((F.col("ts") >= ntz(CUR)) & (F.col("ts") < ntz(_END))).groupBy(F.col("token").alias("word")) \
        .agg(F.count(F.lit(1)).alias("n_now"))
    prev = t.where((F.col("ts") >= ntz(PREV)) & (F.col("ts") < ntz(CUR))).groupBy(F.col("token").alias("word")) \
        .agg(F.count(F.lit(1)).alias("n_prev"))
    j = now.join(prev, "word", "full_outer")
    return j.select("word", F.coalesce("n_now", F.lit(0)).alias("count_today"),
                    F.coalesce("n_prev", F.lit(0)).alias("count_prev"))


@register("agg_window_row_counts", with_fixtures(
    f"""select count(*) filter (where ts >= {_ts(CUR)} and ts < {_ts(_END)}) as now_rows,
        count(*) filter (where ts >= {_ts(PREV)} and ts < {_ts(CUR)}) as prev_rows, count(*) as total_rows from tok""",
    *TREND_FIXTURES, extra=TOK_CTE))
def q_agg_window_row_counts(spark, sf):
    return tr.window_row_counts(_toks(spark, sf), END)


@register("win_growth", with_fixtures(
    "select word, count_today, count_prev, round(cast(count_today - count_prev as double) / cast(count_prev + 1 as double), 9) as growth from cnt",
    *TREND_FIXTURES, extra=TOK_CTE + [("cnt", CNT_SQL)]))
def q_win_growth(spark, sf):
    return _round(_counts(spark, sf).withColumn("growth", tr.growth()))


@register("fn_drop_non_finite", with_fixtures(
    "select word, round(cast(count_today - count_prev as double) / cast(count_prev + 1 as double), 9) as growth from cnt "
    "where isfinite(cast(count_today - count_prev as double) / cast(count_prev + 1 as double))",
    *TREND_FIXTURES, extra=TOK_CTE + [("cnt", CNT_SQL)]))
def q_fn_drop_non_finite(spark, sf):
    g = _counts(spark, sf).withColumn("growth", tr.growth())
    return _round(g.where(tr.finite("growth")).select("word", "growth"))


@register("flt_dynamic_min_count", with_fixtures(
    f"select word, count_today, count_prev, {R9} from ({_scored_sql(4)})", *TREND_FIXTURES,
    extra=TOK_CTE + [("cnt", CNT_SQL)]))
def q_flt_dynamic_min_count(spark, sf):
    return _round(tr.scored(_counts(spark, sf), 4))


@register("fn_trend_score", with_fixtures(
    f"select word, count_today, count_prev, {R9} from ({_scored_sql(4, 0.6, 1.2)})", *TREND_FIXTURES,
    extra=TOK_CTE + [("cnt", CNT_SQL)]))
def q_fn_trend_score(spark, sf):
    return _round(tr.scored(_counts(spark, sf), 4, 0.6, 1.2))


_LIST2 = _lists_sql("sc", 10, "word, count_today, count_prev, growth, score")


@register("flow_trending_2days", with_fixtures(
    f"select word, count_today, count_prev, {R9}, list, rank from ({_LIST2})", *TREND_FIXTURES,
    extra=TOK_CTE + [("cnt", CNT_SQL), ("sc", _scored_sql(4))]))
def q_flow_trending_2days(spark, sf):
    return _round(tr.trending_2days(trend_union(spark, sf), END, top_n=10))


@register("topk_trending", with_fixtures(
    f"select word, count_today, count_prev, {R9}, list, rank from ({_lists_sql('sc', 20, 'word, count_today, count_prev, growth, score')})",
    *TREND_FIXTURES, extra=TOK_CTE + [("cnt", CNT_SQL), ("sc", _scored_sql(4))]))
def q_topk_trending(spark, sf):
    return _round(tr.top_lists(tr.scored(_counts(spark, sf), 4), 20))


@register("win_enumerate_rank", with_fixtures(
    f"""select word, round(score, 9) as score, row_number() over (order by score desc, word) as rank
        from (select * from sc order by score desc, word limit 10)""",
    *TREND_FIXTURES, extra=TOK_CTE + [("cnt", CNT_SQL), ("sc", _scored_sql(4))]))
def q_win_enumerate_rank(spark, sf):
    from pyspark.sql import Window

    top = tr.scored(_counts(spark, sf), 4).orderBy(F.desc("score"), "word").limit(10)
    return _round(top.select("word", "score", F.row_number().over(Window.orderBy(F.desc("score"), "word")).alias("rank")))


DAILY_CTE = [("daily", "select cast(ts as date) as date, token as word, count(*) as n from tok group by 1, 2"),
             ("d2", "select date, row_number() over (order by date desc) as r from (select distinct date from daily) "
                    "order by date desc limit 2"),
             ("dcnt", "select word, sum(case when r = 1 then n else 0 end) as count_today, "
                      "sum(case when r = 2 then n else 0 end) as count_prev from daily join d2 using (date) group by word")]


@register("agg_token_count_daily", with_fixtures("select date, word, n as count from daily", *TREND_FIXTURES,
                                                 extra=TOK_CTE + DAILY_CTE[:1]))
def q_agg_token_count_daily(spark, sf):
    return tr.daily_counts(_toks(spark, sf))


_LAG_SQL = """select coalesce(t.date, p.nxt) as date, coalesce(t.word, p.word) as word, coalesce(t.n, 0) as count_today, coalesce(p.n, 0) as count_prev
    from daily t full join (select d.word, d.n, x.nxt from daily d join nd x on d.date = x.date where x.nxt is not null) p
      on t.date = p.nxt and t.word = p.word"""


@register("win_prev_day_lag", with_fixtures(_LAG_SQL, *TREND_FIXTURES, extra=TOK_CTE + DAILY_CTE[:1] + [
    ("nd", "select date, lead(date) over (order by date) as nxt from (select distinct date from daily)")]))
def q_win_prev_day_lag(spark, sf):
    """Every date of the table; its last one is what the daily trending list is made of."""
    return tr.prev_day_lag(tr.daily_counts(_toks(spark, sf)))


@register("flow_trending_daily", with_fixtures(
    f"select word, count_today, {R9}, list, rank from ({_lists_sql('sc', 20, 'word, count_today, growth, score')})",
    *TREND_FIXTURES, extra=TOK_CTE + DAILY_CTE + [("sc", _scored_sql(10, src="dcnt"))]))
def q_flow_trending_daily(spark, sf):
    return _round(tr.trending_daily(trend_union(spark, sf), top_n=20))


@register("join_stopword_anti", with_fixtures(
    f"""select token, count(*) as n from tok where ts >= {_ts(CUR)} and ts < {_ts(_END)}
        and token not in ({', '.join(ot.q(w) for w in TEST_STOPWORDS)}) group by token""",
    *TREND_FIXTURES, extra=TOK_CTE))
def q_join_stopword_anti(spark, sf):
    from tickpulse.operators.joins import drop_stopwords

    t = _toks(spark, sf).where((F.col("ts") >= ntz(CUR)) & (F.col("ts") < ntz(_END)))
    sw = spark.createDataFrame([(w,) for w in TEST_STOPWORDS], "word string")
    return drop_stopwords(t, sw).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_BINS_SQL = f"""select b.bin, w.word, coalesce(c.n, 0) as count
    from (select word from (select * from sc order by score desc, word limit 10)) w
    cross join (select unnest(generate_series({_ts(PREV)}, {_ts(_END - dt.timedelta(hours=1))}, interval 1 hour)) as bin) b
    left join (select date_trunc('hour', ts) as bin, token as word, count(*) as n from tok
               where ts >= {_ts(PREV)} and ts < {_ts(_END)} group by 1, 2) c on c.bin = b.bin and c.word = w.word"""


@register("agg_token_bins", with_fixtures(_BINS_SQL, *TREND_FIXTURES,
                                          extra=TOK_CTE + [("cnt", CNT_SQL), ("sc", _scored_sql(4))]))
def q_agg_token_bins(spark, sf):
    toks = _span_toks(spark, sf)
    top = tr.scored(tr.window_counts(toks, END), 4).orderBy(F.desc("score"), "word").limit(10).select("word")
    return tr.token_bins(toks, top, END)


_BINS_RC_SQL = f"""select b.bin, w.word, coalesce(c.n, 0) as count
    from (select word from (select * from sc order by score desc, word limit 10)) w
    cross join (select unnest(generate_series({_ts(PREV + dt.timedelta(seconds=1))}, {_ts(_END)}, interval 1 hour)) as bin) b
    left join (select date_trunc('hour', ts) as bin_key, token as word, count(*) as n from tok
               where ts > {_ts(PREV)} and ts <= {_ts(_END)} group by 1, 2) c
      on c.bin_key = date_trunc('hour', b.bin) and c.word = w.word"""


@register("agg_token_bins_right_closed", with_fixtures(_BINS_RC_SQL, *TREND_FIXTURES,
                                                       extra=TOK_CTE + [("cnt", CNT_SQL), ("sc", _scored_sql(4))]))
def q_agg_token_bins_right_closed(spark, sf):
    toks = _span_toks(spark, sf)
    top = tr.scored(tr.window_counts(toks, END), 4).orderBy(F.desc("score"), "word").limit(10).select("word")
    return tr.token_bins(toks, top, END, closed="right")


# ================================================================ post / reply flows
from tickpulse.functions import tickers as tk  # noqa: E402
from tickpulse.operators.sentiment import ColumnScorer  # noqa: E402
from tickpulse.plans import flows  # noqa: E402
from tickpulse.plans.catalog_relational import (REPLY_SUMMARY_SQL, RUMOR_MSG_SQL, RUMOR_WIN, SPLIT_NEW,  # noqa: E402
                                                _reply_summary, rumor_msgs)
from tickpulse.plans.catalog_text import ALL_PATTERNS, CUE_TEXTS, DICT, pattern_sql  # noqa: E402

_STRIP = ot.strip


def _word_score(c):
    """A deterministic scorer with a DuckDB twin (``ot.word_score``), so that the flows' sentiment columns vary."""
    low = F.lower(c)
    up, down = F.contains(low, F.lit(" the ")) | F.contains(low, F.lit("tăng")), F.contains(low, F.lit(" und "))
    return F.struct(F.when(up, "positive").when(down, "negative").otherwise("neutral").alias("label"),
                    F.when(up, 0.9).when(down, 0.8).otherwise(0.6).alias("score"))


WORD_SCORER = ColumnScorer(_word_score, "words")
_LABEL, _SCORE = (lambda x: ot.word_score(x, "label")), (lambda x: ot.word_score(x, "score"))

def _flag_sql(src: str, key: str, text: str, extra_cols: str) -> str:
    return f"(select {key} as doc_id, {text} as text, {extra_cols}, {ot.common_flags(text, DICT.symbols)} from {src})"


_POSTS_LONG = _flag_sql("(select *, nfc_normalize(content) as c from posts where content is not null "
                        f"and length({_STRIP('content')}) >= 10)", "post_id", "c", '"timestamp", platform')
_POST_CODES = f"(select *, {ot.rule_codes('text', DICT.symbols)} as codes from {_POSTS_LONG})"
_POST_BEST = ot.best_sentences(_POST_CODES, ot.split_sentences("text"), "codes", DICT.symbols)
PROCESS_POSTS_SQL = f"""select "timestamp", source, title, symbol, content, sentiment from (select *,
        row_number() over (partition by "timestamp", symbol, content order by source, sentiment) as rn from (
    select "timestamp", platform as source, cast(null as varchar) as title, cast(null as varchar) as symbol,
        content, 'TRUNG_TÍNH' as sentiment from posts where content is not null and length({_STRIP('content')}) < 10
    union all
    select "timestamp", platform, null, null, text, {_LABEL('text')} from {_POST_CODES} where len(codes) = 0
    union all
    select "timestamp", platform, null, code, content, {_LABEL("(case when content <> '' then content else text end)")}
    from (select p."timestamp", p.platform, p.text, b.code,
        case when b.best_pos is null then '' else {ot.context_at('b.ss', 'list_position(b.ss, b.ss[b.best_pos])')} end as content
    from ({_POST_BEST}) b join {_POST_CODES} p on p.doc_id = b.doc_id))) where rn = 1"""


@register("flow_process_posts", with_fixtures(PROCESS_POSTS_SQL, "posts"))
def q_flow_process_posts(spark, sf):
    """Two runs of the job: the posts of the first half of the month, then all posts, of which the ledger leaves the others."""
    from tickpulse.session import scratch_path

    posts, state = fx.posts(spark, sf), scratch_path(spark, "posts-job")
    flows.run_posts(posts.where(F.col("timestamp") < SPLIT_NEW), state, DICT, scorer=WORD_SCORER, buckets=16)
    flows.run_posts(posts, state, DICT, scorer=WORD_SCORER, buckets=16)
    return flows.content_table(spark, state).read().drop("symbol_key")


_REPLIES = """(select r.reply_id, r.post_id, r.rely_content, p."timestamp" from fb_reply r join fb_post p on r.post_id = p.post_id
    where not exists (select 1 from rs where rs.reply_id = r.reply_id))"""
_REPLY_LONG = _flag_sql(f"(select *, nfc_normalize(rely_content) as c from {_REPLIES} where rely_content is not null "
                        f"and length({_STRIP('rely_content')}) >= 5)", "reply_id", "c", 'post_id, "timestamp"')
_REPLY_CODES = f"(select *, {ot.rule_codes('text', DICT.symbols)} as codes from {_REPLY_LONG})"
_REPLY_BEST = ot.best_sentences(_REPLY_CODES, ot.split_sentences("text"), "codes", DICT.symbols)
PROCESS_REPLIES_SQL = f"""
    select reply_id, post_id, cast(null as varchar) as stock_id, cast(null as varchar) as cau_quan_trong,
        'TRUNG_TÍNH' as cam_xuc, "timestamp", 0.5 as confidence_score
    from {_REPLIES} x where rely_content is null or length({_STRIP('rely_content')}) < 5
    union all
    select doc_id, post_id, null, null, 'TRUNG_TÍNH', "timestamp", 0.5 from {_REPLY_CODES} where len(codes) = 0
    union all
    select doc_id, post_id, code, content, {_LABEL('content')}, "timestamp", {_SCORE('content')}
    from (select b.doc_id, p.post_id, b.code, p."timestamp",
        case when b.best_pos is null then '' else {ot.context_at('b.ss', 'list_position(b.ss, b.ss[b.best_pos])')} end as content
    from ({_REPLY_BEST}) b join {_REPLY_CODES} p on p.doc_id = b.doc_id)"""


@register("flow_process_replies", with_fixtures(PROCESS_REPLIES_SQL, "fb_reply", "fb_post",
                                               extra=[("rs", REPLY_SUMMARY_SQL)]))
def q_flow_process_replies(spark, sf):
    return flows.process_replies(fx.fb_reply(spark, sf), fx.fb_post(spark, sf), DICT, _reply_summary(spark, sf), scorer=WORD_SCORER)


_SENT_GATE = f"""case when text is null or text = '' or length({_STRIP('text')}) < 3 then 'Text too short'
        when length({_STRIP(ot.sentiment_clean('nfc_normalize(text)'))}) < 2 then 'Text too short after cleaning'
        else 'words' end"""


@register("flow_sentiment_score", f"""select doc_id, {_LABEL('text')} as sentiment, {_SCORE('text')} as confidence,
        {_SENT_GATE} as sentiment_source from documents""")
def q_flow_sentiment_score(spark, sf):
    from tickpulse.operators.sentiment import transform_sentiment

    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    return transform_sentiment(d, "text", WORD_SCORER).select("doc_id", "sentiment", "confidence", "sentiment_source")


# ================================================================ rumors
# every message ends in one of the cue texts, or in none
_CUED_SQL = f"select id, content || coalesce(' ' || {ot.lst(CUE_TEXTS)}[length(content) % {2 * len(CUE_TEXTS)} + 1], '') as content, date, source, symbols from msgs"


def _cued_msgs(spark, sf):
    cue = F.get(F.array(*[F.lit(x) for x in CUE_TEXTS]), F.length("content") % (2 * len(CUE_TEXTS)))
    m = rumor_msgs(spark, sf)
    return m.withColumn("content", F.concat("content", F.coalesce(F.concat(F.lit(" "), cue), F.lit(""))))


_SYMCSV = ("(case when content is null or content = '' then null else nullif(array_to_string(list_sort(list_distinct("
           "list_filter(regexp_extract_all(upper(content), '[\\p{L}\\p{N}_]+'), lambda w: list_contains("
           + ot.lst(DICT.symbols) + ", w)))), ','), '') end)")
MATCHED_SQL = f"""select id, content, case when source = 'zalo_chat' then {_SYMCSV} else symbols end as symbol, source, date,
        matched_keyword from (select *, {pattern_sql('content')} as matched_keyword from (select *, lower(content) as low from ({_CUED_SQL})))
        where matched_keyword is not null"""
DETECT_SQL = f"""select id, content, symbol, source, date, matched_keyword from (
        select *, row_number() over (partition by content order by case when source = 'fireant_posts' then 0 else 1 end,
            date, id) as rn from ({MATCHED_SQL})) where rn = 1"""


@register("flt_rumor_matched", with_fixtures(MATCHED_SQL, "fireant_posts", "zalo_chat", extra=[("msgs", RUMOR_MSG_SQL)]))
def q_flt_rumor_matched(spark, sf):
    from tickpulse.functions.rumor_rules import rumor_pattern

    m = _cued_msgs(spark, sf).withColumn("matched_keyword", rumor_pattern("content", ALL_PATTERNS))
    m = m.where(F.col("matched_keyword").isNotNull())
    m = m.withColumn("symbol", F.when(F.col("source") == "zalo_chat", tk.symbols_csv("content", DICT))
                     .otherwise(F.col("symbols")))
    return m.select("id", "content", "symbol", "source", "date", "matched_keyword")


@register("flow_detect_rumors", with_fixtures(DETECT_SQL, "fireant_posts", "zalo_chat", extra=[("msgs", RUMOR_MSG_SQL)]))
def q_flow_detect_rumors(spark, sf):
    return flows.detect_rumors(_cued_msgs(spark, sf), DICT, ALL_PATTERNS)


@register("dedup_keep_first_content", """select arg_min(doc_id, doc_id) as doc_id, text from documents group by text""")
def q_dedup_keep_first_content(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    first = flows.dedup_first_content(d.select("*", F.lit("zalo_chat").alias("source"), F.lit(0).alias("date")))
    return first.select(F.col("id").alias("doc_id"), F.col("content").alias("text"))


@register("sink_rumor_append", with_fixtures(
    f"""select "timestamp", symbol, content, sentiment, source from rumors
        union all select date, symbol, content, cast(null as varchar), source from ({DETECT_SQL})""",
    "rumors", "fireant_posts", "zalo_chat", extra=[("msgs", RUMOR_MSG_SQL)]))
def q_sink_rumor_append(spark, sf):
    from tickpulse.operators.upsert import append

    existing = fx.rumors(spark, sf).select("timestamp", "symbol", "content", "sentiment", "source")
    return append(existing, flows.rumors_for_load(flows.detect_rumors(_cued_msgs(spark, sf), DICT, ALL_PATTERNS)))


@register("sink_bulk_rumor", with_fixtures(
    f"""select id, date as "timestamp", symbol, content, cast(null as varchar) as sentiment, source from ({DETECT_SQL})""",
    "fireant_posts", "zalo_chat", extra=[("msgs", RUMOR_MSG_SQL)]))
def q_sink_bulk_rumor(spark, sf):
    det = flows.detect_rumors(_cued_msgs(spark, sf), DICT, ALL_PATTERNS)
    return det.select("id", F.col("date").alias("timestamp"), "symbol", "content",
                      F.lit(None).cast("string").alias("sentiment"), "source")


_VALID_SYM = f"nullif(regexp_replace(upper({_STRIP('symbol')}), '[^A-Z0-9]', '', 'g'), '')"
# two in five rumors open with a cue
_CUED_RUMORS_SQL = """select id, "timestamp", symbol, case id % 5 when 0 then 'Nghe đồn ' || content when 1 then 'Hình như ' || content else content end as content,
    sentiment, source from rumors"""


def _cued_rumors(spark, sf):
    n = F.col("id") % 5
    cue = F.when(n == 0, F.lit("Nghe đồn ")).when(n == 1, F.lit("Hình như ")).otherwise(F.lit(""))
    return fx.rumors(spark, sf).withColumn("content", F.concat(cue, F.col("content")))


_RW = f"(case when length({_STRIP('content')}) < 3 then content else {ot.rewrite_rules('content')} end)"
REWRITE_SQL = f"""select content as original_content, case when {_RW} is null or length({_STRIP(_RW)}) < 3 then content else {_RW} end as rewritten_content,
        {_VALID_SYM} as symbol, sentiment, source, "timestamp", id as processed_from_rumor_id
    from ({_CUED_RUMORS_SQL}) r where not exists (select 1 from rumor_analyst a where a.processed_from_rumor_id = r.id)
        and content is not null and length({_STRIP('content')}) >= 3"""


@register("flow_rewrite_rumors", with_fixtures(REWRITE_SQL, "rumors", "rumor_analyst"))
def q_flow_rewrite_rumors(spark, sf):
    return flows.rewrite_rumors(_cued_rumors(spark, sf), fx.rumor_analyst(spark, sf))


@register("sink_rumor_analyst_append", with_fixtures(
    "select * from rumor_analyst union all " + REWRITE_SQL, "rumors", "rumor_analyst"))
def q_sink_rumor_analyst_append(spark, sf):
    from tickpulse.operators.upsert import append

    existing = fx.rumor_analyst(spark, sf)
    return append(existing, flows.rewrite_rumors(_cued_rumors(spark, sf), existing))


# ================================================================ YouTube mentions
from tickpulse.plans.catalog_relational import YT_WINDOW_SQL  # noqa: E402

# FIXED VALUES: title-case words that act as case-sensitive "tickers" in the test text
YT_TICKERS = ["The", "Les", "Die", "Der", "Que", "El", "La"]


def _yt(spark, sf):
    from tickpulse.plans.catalog_relational import YT_WIN, _epoch_dt
    from tickpulse.sources.unified import yt_window

    return yt_window(fx.yt_post(spark, sf), _epoch_dt(YT_WIN[0]), _epoch_dt(YT_WIN[1]))


@register("flow_yt_mentions", with_fixtures(f"select * from {ot.mentions('yt_post', YT_TICKERS, 20)}", "yt_post"))
def q_flow_yt_mentions(spark, sf):
    return flows.yt_mentions(fx.yt_post(spark, sf), YT_TICKERS)


_ADVICE_SQL = f"""select distinct floor(epoch(post_at))::bigint as "timestamp", post_ticker as symbol, context as advise, post_id as source
    from {ot.mentions('yt_win', YT_TICKERS, 20)}"""


@register("flow_yt_job", with_fixtures(
    f"""select * from youtuber_advice union all by name select * from ({_ADVICE_SQL}) i where not exists (select 1 from youtuber_advice e
        where e."timestamp" = i."timestamp" and e.symbol = i.symbol and e.advise = i.advise and e.source = i.source)""",
    "yt_post", "youtuber_advice", extra=[("yt_win", YT_WINDOW_SQL)]))
def q_flow_yt_job(spark, sf):
    from tickpulse.plans.catalog_relational import committed

    new = flows.advice_rows(flows.yt_mentions(_yt(spark, sf), YT_TICKERS))
    table = committed(fx.youtuber_advice(spark, sf), "youtuber-advice", ["timestamp", "symbol", "advise", "source"])
    table.merge(new, "ignore")
    return table.read()


@register("sink_advice_ignore", with_fixtures(
    f"""select * from youtuber_advice where "timestamp" < {SPLIT_NEW + 5 * 86400}
        union all select distinct * from youtuber_advice i where "timestamp" >= {SPLIT_NEW}
        and not exists (select 1 from youtuber_advice e where e."timestamp" < {SPLIT_NEW + 5 * 86400}
            and e."timestamp" = i."timestamp" and e.symbol = i.symbol and e.advise = i.advise and e.source = i.source)""",
    "youtuber_advice"))
def q_sink_advice_ignore(spark, sf):
    from tickpulse.plans.catalog_relational import committed

    a = fx.youtuber_advice(spark, sf)
    old = a.where(F.col("timestamp") < SPLIT_NEW + 5 * 86400)
    table = committed(old, "youtuber-advice", ["timestamp", "symbol", "advise", "source"])
    table.merge(a.where(F.col("timestamp") >= SPLIT_NEW), "ignore")
    return table.read()


# ================================================================ calendar
_HAS_DATE = "(date is not null and regexp_replace(date, '\\s', '', 'g') <> '')"
_RUN = "rows between unbounded preceding and current row"
CAL_CTE = [
    ("cr", f"""select *, sum(case when {_HAS_DATE} then 1 else 0 end) over (partition by page_id order by row_idx {_RUN}) as grp,
        last_value(case when {_HAS_DATE} then date end ignore nulls) over (partition by page_id order by row_idx {_RUN}) as hdr
        from calendar_raw"""),
    ("ce", f"select * from cr where grp > 0 and {_STRIP('event')} <> ''"),
    ("cf", f"""select *, coalesce(last_value(nullif({_STRIP('time')}, '') ignore nulls) over
        (partition by page_id, grp order by row_idx {_RUN}), '') as event_time,
        case when regexp_replace(hdr, '\\s', '', 'g') = '' then ''
             else strftime(strptime(regexp_replace({_STRIP('hdr')}, '^\\S+\\s+', '') || ' 2024', '%b %d %Y'), '%Y-%m-%d')
        end as event_date from ce"""),
    ("flat", """select page_id, grp, row_idx, event_date, event_time, currency, impact, event, actual, forecast, previous
        from cf where event_date <> ''"""),
]
CAL_FIX = ("calendar_raw",)


def _flat(spark, sf):
    return flows.calendar_events(fx.calendar_raw(spark, sf), fx.RUN_TIME)


@register("flow_calendar", with_fixtures("select * from flat", *CAL_FIX, extra=CAL_CTE))
def q_flow_calendar(spark, sf):
    return _flat(spark, sf)


@register("win_ffill_date", with_fixtures("select row_idx, hdr as date_header, grp from cr where grp > 0", *CAL_FIX,
                                          extra=CAL_CTE[:1]))
def q_win_ffill_date(spark, sf):
    r = flows.calendar_headers(fx.calendar_raw(spark, sf))
    return r.where("grp > 0").select("row_idx", F.col("_hdr").alias("date_header"), "grp")


@register("win_ffill_time", with_fixtures("select row_idx, event_time from cf", *CAL_FIX, extra=CAL_CTE[:3]))
def q_win_ffill_time(spark, sf):
    r = flows.calendar_headers(fx.calendar_raw(spark, sf))
    r = r.where((F.col("grp") > 0) & (F.regexp_replace("event", r"(?U)^\s+|\s+$", "") != ""))
    return flows.calendar_times(r).select("row_idx", "event_time")


@register("fn_nest_events", with_fixtures(
    """select event_date as date, page_id, grp, count(*) as n_events, arg_min(event, row_idx) as first_event,
        arg_max(event, row_idx) as last_event from flat group by 1, 2, 3""", *CAL_FIX, extra=CAL_CTE))
def q_fn_nest_events(spark, sf):
    n = flows.nest_events(_flat(spark, sf))
    return n.select("date", "page_id", "grp", F.size("events").alias("n_events"),
                    F.element_at("events", 1)["event"].alias("first_event"),
                    F.element_at("events", -1)["event"].alias("last_event"))


@register("fn_unnest_events", with_fixtures("select * from flat", *CAL_FIX, extra=CAL_CTE))
def q_fn_unnest_events(spark, sf):
    u = flows.unnest_events(flows.nest_events(_flat(spark, sf)))
    return u.select("page_id", "grp", "row_idx", "event_date", "event_time", "currency", "impact", "event", "actual",
                    "forecast", "previous")


@register("sink_calendar_json", with_fixtures("select * from flat", *CAL_FIX, extra=CAL_CTE))
def q_sink_calendar_json(spark, sf):
    from tickpulse.session import scratch_path

    path = scratch_path(spark, "calendar-json")
    flows.nest_events(_flat(spark, sf)).write.mode("overwrite").json(path)
    back = spark.read.schema(
        "date string, events array<struct<row_idx:bigint,time:string,currency:string,impact:string,event:string,"
        "actual:string,forecast:string,previous:string>>, page_id bigint, grp bigint").json(path)
    u = flows.unnest_events(back)
    return u.select("page_id", "grp", "row_idx", "event_date", "event_time", "currency", "impact", "event", "actual",
                    "forecast", "previous")


@register("sink_calendar_upsert", with_fixtures(
    """select event_date, event_time, currency, impact, event, actual, forecast, previous from (
        select *, row_number() over (partition by event_date, event_time, event order by page_id desc, row_idx desc) as rn
        from flat) where rn = 1""", *CAL_FIX, extra=CAL_CTE))
def q_sink_calendar_upsert(spark, sf):
    from tickpulse.session import scratch_path

    flat = _flat(spark, sf)
    existing = flat.where(F.col("event_date") < "2024-01-10").withColumn("actual", F.lit("old")) \
        .select("event_date", "event_time", "currency", "impact", "event", "actual", "forecast", "previous")
    return flows.calendar_upsert(existing, flat, scratch_path(spark, "calendar"))


# ================================================================ trending job and file sinks
def _trend_rows(lists, interval: str, ts: int):
    s = lists.where(F.col("list") == "score")
    return s.select(F.lit(interval).alias("interval"), F.col("rank").alias("row_num"), F.col("word").alias("keyword"),
                    F.col("count_today").alias("total"), F.round("score", 9).alias("score"),
                    F.lit(ts).cast("bigint").alias("timestamp"))


_END_EP = int((END - dt.timedelta(hours=7) - dt.datetime(1970, 1, 1)).total_seconds())
_DAILY_LISTS = _lists_sql("sc", 20, "word, count_today, growth, score")
_TREND_ROWS = ("select '{iv}' as \"interval\", rank as row_num, word as keyword, count_today as total, "
               "round(score, 9) as score, cast({ts} as bigint) as \"timestamp\" from ({src}) where list = 'score'")


@register("sink_trending_upsert", with_fixtures(
    """select * from ex e where not exists (select 1 from inc i where i."interval" = e."interval" and i.row_num = e.row_num)
        union all select * from inc""",
    *TREND_FIXTURES, extra=TOK_CTE + [("cnt", CNT_SQL), ("sc", _scored_sql(4))] + DAILY_CTE + [
        ("scd", _scored_sql(10, src="dcnt")),
        ("ex", _TREND_ROWS.format(iv="24h", ts=_END_EP - 86400, src=_lists_sql("scd", 20, "word, count_today, growth, score"))),
        ("inc", _TREND_ROWS.format(iv="24h", ts=_END_EP, src=_LIST2))]))
def q_sink_trending_upsert(spark, sf):
    from tickpulse.operators.upsert import upsert_ranks

    tu = trend_union(spark, sf)
    ex = _trend_rows(tr.trending_daily(tu, top_n=20), "24h", _END_EP - 86400)
    inc = _trend_rows(tr.trending_2days(tu, END, top_n=10), "24h", _END_EP)
    return upsert_ranks(ex, inc, ["interval", "row_num"])


@register("flow_trending_job", with_fixtures(
    f"""select 'daily' as analysis, word, count_today, {R9}, list, rank from ({_lists_sql('scd', 20, 'word, count_today, growth, score')})
        union all select '2days', word, count_today, {R9}, list, rank from ({_LIST2})""",
    *TREND_FIXTURES, extra=TOK_CTE + [("cnt", CNT_SQL), ("sc", _scored_sql(4))] + DAILY_CTE + [
        ("scd", _scored_sql(10, src="dcnt"))]))
def q_flow_trending_job(spark, sf):
    """Both analyses over one load of the texts (hourly cadence in the reference): the sources are joined and written once."""
    from tickpulse.session import scratch_path

    path = scratch_path(spark, "trend-texts")
    trend_union(spark, sf).write.option("compression", "zstd").parquet(path)
    tu = spark.read.parquet(path)
    daily = tr.trending_daily(tu, top_n=20).withColumn("analysis", F.lit("daily"))
    two = tr.trending_2days(tu, END, top_n=10).drop("count_prev").withColumn("analysis", F.lit("2days"))
    return _round(daily.unionByName(two))


@register("sink_csv", with_fixtures(f"select word, count_today, count_prev, {R9}, list, rank from ({_LIST2})",
                                    *TREND_FIXTURES, extra=TOK_CTE + [("cnt", CNT_SQL), ("sc", _scored_sql(4))]))
def q_sink_csv(spark, sf):
    from tickpulse.session import scratch_path

    path = scratch_path(spark, "trending-csv")
    out = _round(tr.trending_2days(trend_union(spark, sf), END, top_n=10))
    out.write.mode("overwrite").option("header", True).csv(path)
    schema = "word string, count_today bigint, count_prev bigint, growth double, score double, list string, rank int"
    back = spark.read.option("header", True).schema(schema).csv(path)
    return back.select("word", "count_today", "count_prev", "growth", "score", "list", "rank")


@register("sink_jsonl", with_fixtures("select text, label, stock_code, has_stock from labelled", "labelled"))
def q_sink_jsonl(spark, sf):
    from tickpulse.session import scratch_path
    from tickpulse.sources.unified import read_labelled_jsonl

    path = scratch_path(spark, "training-jsonl")
    fx.labelled(spark, sf).select("text", "label", "stock_code", "has_stock").write.mode("overwrite").json(path)
    return read_labelled_jsonl(spark, path)


@register("sink_table_export", with_fixtures(
    "select text, label, stock_code, has_stock, cast(null as varchar) as note from labelled", "labelled"))
def q_sink_table_export(spark, sf):
    from tickpulse.operators.training import export_columns
    from tickpulse.session import scratch_path

    path = scratch_path(spark, "export-csv")
    lab = fx.labelled(spark, sf).select("text", "label", "stock_code", "has_stock")
    out = export_columns(lab, ["text", "label", "stock_code", "has_stock", "note"])
    opts = {"header": True, "nullValue": "\\N", "multiLine": True, "escape": '"'}
    out.write.mode("overwrite").options(**opts).option("emptyValue", '""').csv(path)
    back = spark.read.options(**opts).option("emptyValue", "").schema(
        "text string, label string, stock_code string, has_stock boolean, note string").csv(path)
    return back


_CLEAN = ot.summary_clean("text")
_SAID = f"('Tóm tắt: ' || substring({_CLEAN}, 1, 60))"
_SAID_FREE = rf"regexp_replace({_SAID}, '(?i)\b(vietnews|tóm tắt|summary):?\s*', '', 'g')"


@register("flow_summarize", f"""select a.doc_id, b.summary, case when a.words < 20 then b.summary when {ot.word_count('s')} < 5 then c.summary
        when regexp_matches(s, '[.!?]$') then s else regexp_replace(s, '\\s+$', '') || '.' end as model_summary
    from (select doc_id, {ot.word_count(_CLEAN)} as words, {_SAID_FREE} as s from documents) a
    join {ot.smart_summary("documents", _CLEAN, 150)} b on b.doc_id = a.doc_id
    join {ot.smart_summary(f"(select doc_id, {_CLEAN} as text from documents)", _CLEAN, 100)} c on c.doc_id = a.doc_id""")
def q_flow_summarize(spark, sf):
    """Without a model, and with a stand-in that says the first 60 characters under a label: the 20-word gate and the post-processing run."""
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    d = flows.summarize(d, "text")
    with_model = flows.summarize(d.withColumnRenamed("summary", "plain"), "text", summarizer=lambda c: F.concat(F.lit("Tóm tắt: "), F.substring(c, 1, 60)))
    return with_model.select("doc_id", F.col("plain").alias("summary"), F.col("summary").alias("model_summary"))


# ================================================================ streams
def _in_two_runs(rows, name: str, run):
    """The stream of ``rows`` as two scheduled runs: half of the files arrive, a run reads them, the others arrive, the next run
    goes on from its state.  ``run(source, schema, state)`` is called once for each."""
    from tickpulse.session import scratch_path

    spark = rows.sparkSession
    source, state = scratch_path(spark, name), scratch_path(spark, name + "-state")
    half = F.pmod(F.xxhash64(*rows.columns), F.lit(2))
    rows.where(half == 0).write.parquet(source)
    run(source, rows.schema, state)
    rows.where(half == 1).write.mode("append").parquet(source)
    return run(source, rows.schema, state)


_FEW_FILES = {"maxFilesPerTrigger": 8}


@register("st_incremental_posts", with_fixtures(PROCESS_POSTS_SQL, "posts"))
def q_st_incremental_posts(spark, sf):
    from tickpulse.streaming.streams import incremental_posts

    return _in_two_runs(fx.posts(spark, sf), "posts-stream", lambda *at: incremental_posts(spark, *at, DICT, scorer=WORD_SCORER, options=_FEW_FILES))


@register("st_sliding_tokens", with_fixtures(
    f"""select window_start, window_start + interval 24 hour as window_end, token, count(*) as n from (
        select unnest(generate_series(time_bucket(interval 1 hour, ts) - interval 23 hour, time_bucket(interval 1 hour, ts),
            interval 1 hour)) as window_start, token
        from (select make_timestamp(date * 1000000) as ts, unnest({ot.tokenize('content')}) as token from zalo_chat
              where content is not null and content <> 'NA'))
    group by 1, 2, 3""", "zalo_chat"))
def q_st_sliding_tokens(spark, sf):
    from tickpulse.functions.timewin import ts_of_epoch
    from tickpulse.streaming.streams import sliding_tokens

    z = fx.zalo_chat(spark, sf).where(F.col("content").isNotNull() & (F.col("content") != "NA"))
    z = z.select(ts_of_epoch("date").alias("ts"), "content")
    return _in_two_runs(z, "tokens-stream", lambda *at: sliding_tokens(spark, *at, "ts", "content", options=_FEW_FILES))


@register("st_tumbling_stock_sentiment", with_fixtures(
    """select make_timestamp(("timestamp" - 28800 - (("timestamp" - 28800) % 86400) + 28800) * 1000000) as window_start,
        symbol, count(*) filter (where sentiment = 'TÍCH_CỰC') as positive,
        count(*) filter (where sentiment = 'TIÊU_CỰC') as negative,
        count(*) filter (where sentiment = 'TRUNG_TÍNH') as neutral, count(*) as total
    from all_content where symbol is not null group by 1, 2""", "all_content"))
def q_st_tumbling_stock_sentiment(spark, sf):
    from tickpulse.streaming.streams import tumbling_stock_sentiment

    rows = fx.all_content(spark, sf).select("timestamp", "symbol", "sentiment")
    return _in_two_runs(rows, "sentiment-stream", lambda *at: tumbling_stock_sentiment(spark, *at, options=_FEW_FILES))
