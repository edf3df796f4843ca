"""Registered queries: sources, filters, joins, roll-ups, ranking and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickpulse.functions.timewin import half_open_day, interval_bounds, to_epoch
from tickpulse.operators import rollup
from tickpulse.plans.oracle_fixtures import with_fixtures
from tickpulse.plans.registry import register
from tickpulse.sources import fixtures as fx

RUN = fx.RUN_TIME
B24 = interval_bounds("24h", RUN)
BWEEK = interval_bounds("week", RUN)
BMONTH = interval_bounds("month", RUN)
DAY = half_open_day(RUN, 0)


def _stock_sql(interval: str, b) -> str:
    return f"""select symbol, '{interval}' as "interval",
        sum(case when sentiment = 'TÍCH_CỰC' then 1 else 0 end) as positive,
        sum(case when sentiment = 'TIÊU_CỰC' then 1 else 0 end) as negative,
        sum(case when sentiment = 'TRUNG_TÍNH' then 1 else 0 end) as neutral,
        count(symbol) as total, cast({b[1]} as bigint) as "timestamp"
        from all_content where symbol is not null and "timestamp" between {b[0]} and {b[1]}
        group by symbol"""


# ---------------------------------------------------------------- roll-ups
@register("agg_stock_sentiment", with_fixtures(_stock_sql("24h", B24), "all_content"))
def q_agg_stock_sentiment(spark, sf):
    return rollup.stock_sentiment(fx.all_content(spark, sf), "24h", RUN)


@register("agg_interval_bounds", with_fixtures(
    _stock_sql("24h", B24) + " union all " + _stock_sql("week", BWEEK) + " union all " + _stock_sql("month", BMONTH),
    "all_content"))
def q_agg_interval_bounds(spark, sf):
    return rollup.stock_sentiment_all_intervals(fx.all_content(spark, sf), RUN)


_TOP_SQL = """select symbol, "interval", positive, negative, neutral, total,
        row_number() over (order by total desc, symbol) as row_num, "timestamp" as updated_at
        from ss where "interval" = '24h' and "timestamp" = (select max("timestamp") from ss where "interval" = '24h')
        order by total desc, symbol limit 10"""


@register("win_top10_rank", with_fixtures(
    _TOP_SQL, "all_content",
    extra=[("ss", _stock_sql("24h", B24) + " union all " + _stock_sql("week", BWEEK))]))
def q_win_top10_rank(spark, sf):
    ac = fx.all_content(spark, sf)
    ss = rollup.stock_sentiment(ac, "24h", RUN).unionByName(rollup.stock_sentiment(ac, "week", RUN))
    return rollup.top_stocks(ss, "24h")


_DAILY_SQL = f"""select cast({DAY[0]} as bigint) as "timestamp", count(*) as total,
        count(case when sentiment = 'TÍCH_CỰC' then 1 end) as total_positive,
        count(case when sentiment = 'TIÊU_CỰC' then 1 end) as total_negative,
        count(case when sentiment = 'TRUNG_TÍNH' then 1 end) as total_neutral,
        count(case when source = 'news' then 1 end) as news,
        count(case when source = 'fireant' then 1 end) as fireant,
        count(case when source = 'zalo' then 1 end) as zalo,
        count(case when source = 'facebook' then 1 end) as facebook,
        count(case when source = 'youtube' then 1 end) as youtube,
        count(case when source = 'tiktok' then 1 end) as tiktok,
        count(case when sentiment = 'TÍCH_CỰC' then 1 end) / (case when count(*) = 0 then 1 else count(*) end) * 100.0 as aim_score
        from all_content where "timestamp" >= {DAY[0]} and "timestamp" < {DAY[1]}"""


@register("agg_daily_statistics", with_fixtures(_DAILY_SQL, "all_content"))
def q_agg_daily_statistics(spark, sf):
    return rollup.daily_statistics(fx.all_content(spark, sf), RUN)


# ---------------------------------------------------------------- shared anchors
from tickpulse.functions.text import strip, stripped_length, text_present, validate_symbol  # noqa: E402
from tickpulse.functions.timewin import epoch_seconds_rounded  # noqa: E402
from tickpulse.operators import joins, upsert  # noqa: E402
from tickpulse.sources import unified  # noqa: E402
from tickpulse.constants import CLASS_ID_LABEL_MAP, CUSTOM_LABEL_MAP, EN_TO_VI_LABEL_MAP, MODEL_LABEL_MAP, NEUTRAL, VI_TO_EN_LABEL_MAP
import datetime as _dt  # noqa: E402

NOW = to_epoch(RUN)
SPLIT_OLD = to_epoch(fx.SPLIT_EXISTING_BEFORE)   # existing rows: timestamp < SPLIT_OLD
SPLIT_NEW = to_epoch(fx.SPLIT_INCOMING_FROM)     # incoming rows: timestamp >= SPLIT_NEW
RUMOR_WIN = half_open_day(RUN, 8)
YT_WIN = half_open_day(RUN, 7)
TREND_SINCE = _dt.datetime(2024, 1, 7, 17, 0, 0)  # midnight 2024-01-08 in Bangkok, as UTC


def _epoch_dt(e):
    return _dt.datetime(1970, 1, 1) + _dt.timedelta(seconds=e)


# ---------------------------------------------------------------- 2.1 sources
@register("src_facebook", with_fixtures(
    """select 'facebook' as platform, post_id, content, "timestamp" from fb_post""", "fb_post"))
def q_src_facebook(spark, sf):
    return unified.src_facebook(fx.fb_post(spark, sf))


@register("src_youtube", with_fixtures(
    """select 'youtube' as platform, source as post_id, advise as content, "timestamp" from youtuber_advice""",
    "youtuber_advice"))
def q_src_youtube(spark, sf):
    return unified.src_youtube(fx.youtuber_advice(spark, sf))


_FIREANT_SQL = """select 'fireant' as platform, post_id, original_content as content,
        cast(round(epoch(date)) as bigint) as "timestamp" from fireant_posts"""


@register("src_fireant", with_fixtures(_FIREANT_SQL, "fireant_posts"))
def q_src_fireant(spark, sf):
    return unified.src_fireant(fx.fireant_posts(spark, sf))


_ZALO_SQL = """select 'zalo' as platform, cast(id as varchar) as post_id, content, date as "timestamp" from zalo_chat"""


@register("src_zalo", with_fixtures(_ZALO_SQL, "zalo_chat"))
def q_src_zalo(spark, sf):
    return unified.src_zalo(fx.zalo_chat(spark, sf))


_UNIFIED_SQL = f"""select 'facebook' as platform, post_id, content, "timestamp" from fb_post
    union all select 'youtube', source, advise, "timestamp" from youtuber_advice
    union all {_FIREANT_SQL}
    union all {_ZALO_SQL}"""


def _unified(spark, sf):
    return unified.unified_posts(fx.fb_post(spark, sf), fx.youtuber_advice(spark, sf),
                                 fx.fireant_posts(spark, sf), fx.zalo_chat(spark, sf))


@register("src_unified_posts", with_fixtures(_UNIFIED_SQL, "fb_post", "youtuber_advice", "fireant_posts", "zalo_chat"))
def q_src_unified_posts(spark, sf):
    return _unified(spark, sf)


_TS = "TIMESTAMP '2024-01-07 17:00:00'"
_TS_EP = to_epoch(TREND_SINCE)
TREND_UNION_SQL = f"""select date, original_content as content from fireant_posts where date >= {_TS}
    union all select make_timestamp("timestamp" * 1000000), content from fb_post where "timestamp" >= {_TS_EP}
    union all select make_timestamp(p."timestamp" * 1000000), r.rely_content from fb_reply r
        join fb_post p on p.post_id = r.post_id where p."timestamp" >= {_TS_EP}
    union all select make_timestamp(date * 1000000), content from zalo_chat
        where date >= {_TS_EP} and content is not null and content <> 'NA'
    union all select post_at, post_content from yt_post where post_at >= {_TS} and post_content <> ''"""
TREND_FIXTURES = ("fireant_posts", "fb_post", "fb_reply", "zalo_chat", "yt_post")


def trend_union(spark, sf):
    return unified.trending_union(fx.fireant_posts(spark, sf), fx.fb_post(spark, sf), fx.fb_reply(spark, sf),
                                  fx.zalo_chat(spark, sf), fx.yt_post(spark, sf), TREND_SINCE)


@register("src_trending_union", with_fixtures(TREND_UNION_SQL, *TREND_FIXTURES))
def q_src_trending_union(spark, sf):
    return trend_union(spark, sf)


_RW0 = _epoch_dt(RUMOR_WIN[0]).isoformat(sep=" ")
_RW1 = _epoch_dt(RUMOR_WIN[1]).isoformat(sep=" ")
FIREANT_TAGGED_SQL = f"""select post_id as id, original_content as content,
        cast(round(epoch(date)) as bigint) as date, 'fireant_posts' as source,
        (select string_agg(s, ', ' order by s) from (select unnest(t).symbol as s) where s is not null) as symbols
    from (select *, from_json(tagged_symbols, '[{{"symbol":"VARCHAR"}}]') as t from fireant_posts)
    where date >= TIMESTAMP '{_RW0}' and date < TIMESTAMP '{_RW1}' and len(t) > 0"""
CONCAT_SQL = f"""select cast(min(id) as varchar) as id, string_agg(content, ' || ' order by id) as content,
        date, 'zalo_chat' as source, '' as symbols
    from zalo_chat where content <> 'NA' and date >= {RUMOR_WIN[0]} and date < {RUMOR_WIN[1]} group by date"""
RUMOR_MSG_SQL = FIREANT_TAGGED_SQL + "\n union all \n" + CONCAT_SQL


def rumor_msgs(spark, sf):
    return unified.rumor_messages(fx.fireant_posts(spark, sf), fx.zalo_chat(spark, sf),
                                  _epoch_dt(RUMOR_WIN[0]), _epoch_dt(RUMOR_WIN[1]))


@register("src_rumor_messages", with_fixtures(RUMOR_MSG_SQL, "fireant_posts", "zalo_chat"))
def q_src_rumor_messages(spark, sf):
    return rumor_msgs(spark, sf)


@register("agg_symbols_string", with_fixtures(FIREANT_TAGGED_SQL, "fireant_posts"))
def q_agg_symbols_string(spark, sf):
    return unified.fireant_tagged(fx.fireant_posts(spark, sf), _epoch_dt(RUMOR_WIN[0]), _epoch_dt(RUMOR_WIN[1]))


@register("concat_by_second", with_fixtures(CONCAT_SQL, "zalo_chat"))
def q_concat_by_second(spark, sf):
    return unified.concat_by_second(fx.zalo_chat(spark, sf), RUMOR_WIN[0], RUMOR_WIN[1])


_YW0 = _epoch_dt(YT_WIN[0]).isoformat(sep=" ")
_YW1 = _epoch_dt(YT_WIN[1]).isoformat(sep=" ")
YT_WINDOW_SQL = f"""select post_id, post_content, post_at from yt_post
    where post_at >= TIMESTAMP '{_YW0}' and post_at < TIMESTAMP '{_YW1}'"""


@register("src_yt_window", with_fixtures(YT_WINDOW_SQL, "yt_post"))
def q_src_yt_window(spark, sf):
    return unified.yt_window(fx.yt_post(spark, sf), _epoch_dt(YT_WIN[0]), _epoch_dt(YT_WIN[1]))


@register("src_tickers", with_fixtures(
    "select distinct upper(symbol) as symbol from institution_profiles where symbol <> ''", "institution_profiles"))
def q_src_tickers(spark, sf):
    return unified.ticker_dimension(fx.institution_profiles(spark, sf))


@register("src_stopwords", """select distinct w as word from (
        select regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') as w from documents)
    where w <> ''""")
def q_src_stopwords(spark, sf):
    from tickpulse.session import scratch_path

    path = scratch_path(spark, "stopword-lines")
    lines = fx.table(spark, sf, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
    lines.write.mode("overwrite").text(path)
    return unified.read_stopwords(spark, path)


LABELLED_SQL = "select text, label, stock_code, has_stock from labelled"


@register("src_labelled_jsonl", with_fixtures(LABELLED_SQL, "labelled"))
def q_src_labelled_jsonl(spark, sf):
    from tickpulse.session import scratch_path

    path = scratch_path(spark, "labelled-jsonl")
    lab = fx.labelled(spark, sf)
    # absent fields are left out of the JSON lines, so the reader's defaults must restore them
    lab.select("text", "label", F.nullif("stock_code", F.lit("")).alias("stock_code"),
               F.when(F.col("has_stock"), F.lit(True)).alias("has_stock")).write.mode("overwrite").json(path)
    return unified.read_labelled_jsonl(spark, path)


@register("src_pairs_jsonl", with_fixtures(
    "select original, rewritten from rewrite_pairs where original <> '' and rewritten <> ''", "rewrite_pairs"))
def q_src_pairs_jsonl(spark, sf):
    from tickpulse.session import scratch_path

    path = scratch_path(spark, "pairs-jsonl")
    fx.rewrite_pairs(spark, sf).select("original", F.col("rewritten").alias("rewriter")).write.mode("overwrite").json(path)
    return unified.read_pairs_jsonl(spark, path)


@register("src_multi_jsonl", with_fixtures(LABELLED_SQL, "labelled"))
def q_src_multi_jsonl(spark, sf):
    from tickpulse.session import scratch_path

    lab = fx.labelled(spark, sf).select("text", "label", "stock_code", "has_stock")
    p1, p2 = scratch_path(spark, "multi-a"), scratch_path(spark, "multi-b")
    lab.where("has_stock").write.mode("overwrite").json(p1)
    lab.where("not has_stock").write.mode("overwrite").json(p2)
    return unified.read_multi_jsonl(spark, [p1, scratch_path(spark, "missing"), p2])


_STATS_DAYS_SQL = """select "timestamp" - ("timestamp" % 86400) as "timestamp", count(*) as total,
        count(case when sentiment = 'TÍCH_CỰC' then 1 end) as total_positive,
        count(case when sentiment = 'TIÊU_CỰC' then 1 end) as total_negative,
        count(case when sentiment = 'TRUNG_TÍNH' then 1 end) as total_neutral,
        count(case when source = 'news' then 1 end) as news,
        count(case when source = 'fireant' then 1 end) as fireant,
        count(case when source = 'zalo' then 1 end) as zalo,
        count(case when source = 'facebook' then 1 end) as facebook,
        count(case when source = 'youtube' then 1 end) as youtube,
        count(case when source = 'tiktok' then 1 end) as tiktok,
        count(case when sentiment = 'TÍCH_CỰC' then 1 end) / (case when count(*) = 0 then 1 else count(*) end) * 100.0 as aim_score
    from {src} group by 1"""
_RECENT_START = to_epoch(_dt.datetime(2024, 1, 8))
_RECENT_SQL = f"""select strftime(make_timestamp("timestamp" * 1000000), '%Y-%m-%d') as date, total, total_positive,
        total_negative, total_neutral, news, fireant, zalo, facebook, youtube, tiktok, aim_score, "timestamp"
    from stats where "timestamp" >= {_RECENT_START} order by "timestamp" desc"""


@register("src_recent_stats", with_fixtures(_RECENT_SQL, "all_content",
                                            extra=[("stats", _STATS_DAYS_SQL.format(src="all_content"))]))
def q_src_recent_stats(spark, sf):
    return rollup.recent_statistics(rollup.daily_statistics_all_days(fx.all_content(spark, sf)), RUN, 7)


@register("sort_recent_stats", with_fixtures(
    "select * from stats order by \"timestamp\" desc", "all_content",
    extra=[("stats", _STATS_DAYS_SQL.format(src="all_content"))]))
def q_sort_recent_stats(spark, sf):
    return rollup.daily_statistics_all_days(fx.all_content(spark, sf)).orderBy(F.desc("timestamp"))


# ---------------------------------------------------------------- 2.3 filters
@register("flt_last_24h", with_fixtures(f"select * from up where \"timestamp\" >= {NOW - 86400}",
                                        "fb_post", "youtuber_advice", "fireant_posts", "zalo_chat",
                                        extra=[("up", _UNIFIED_SQL)]))
def q_flt_last_24h(spark, sf):
    return unified.posts_since(_unified(spark, sf), NOW)


@register("flt_half_open_day", with_fixtures(
    f'select * from all_content where "timestamp" >= {DAY[0]} and "timestamp" < {DAY[1]}', "all_content"))
def q_flt_half_open_day(spark, sf):
    return fx.all_content(spark, sf).where((F.col("timestamp") >= DAY[0]) & (F.col("timestamp") < DAY[1]))


@register("flt_8h_window_half_open", with_fixtures(
    f'select * from all_content where "timestamp" >= {RUMOR_WIN[0]} and "timestamp" < {RUMOR_WIN[1]}', "all_content"))
def q_flt_8h_window_half_open(spark, sf):
    return fx.all_content(spark, sf).where((F.col("timestamp") >= RUMOR_WIN[0]) & (F.col("timestamp") < RUMOR_WIN[1]))


@register("flt_between_inclusive", with_fixtures(
    f'select * from all_content where "timestamp" between {B24[0]} and {B24[1]}', "all_content"))
def q_flt_between_inclusive(spark, sf):
    return fx.all_content(spark, sf).where(F.col("timestamp").between(B24[0], B24[1]))


@register("flt_text_present", with_fixtures(
    "select * from zalo_chat where content is not null and content <> '' and content <> 'NA'", "zalo_chat"))
def q_flt_text_present(spark, sf):
    return unified.present_text(fx.zalo_chat(spark, sf), "content")


_STRIP_SQL = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@register("flt_short_text_route", with_fixtures(
    f"""select "timestamp", platform as source, cast(null as varchar) as title, cast(null as varchar) as symbol,
        content, 'TRUNG_TÍNH' as sentiment
    from posts where content is null or length({_STRIP_SQL.format(c='content')}) < 10""", "posts"))
def q_flt_short_text_route(spark, sf):
    from tickpulse.plans.flows import short_post_rows

    return short_post_rows(fx.posts(spark, sf))


CUT_REPLY_SQL = """select reply_id, post_id, substr(rely_content, 1, cast(reply_id as bigint) % 9) as rely_content from fb_reply"""


@register("flt_short_reply_route", with_fixtures(
    f"""select r.reply_id, r.post_id, cast(null as varchar) as stock_id, cast(null as varchar) as cau_quan_trong,
        'TRUNG_TÍNH' as cam_xuc, p."timestamp"
    from (select * from fb_reply union all ({CUT_REPLY_SQL})) r join fb_post p on r.post_id = p.post_id
    where r.rely_content is null or length({_STRIP_SQL.format(c='r.rely_content')}) < 5""", "fb_reply", "fb_post"))
def q_flt_short_reply_route(spark, sf):
    """All replies, and all of them again cut to 0 to 8 characters, so that the route takes some."""
    from tickpulse.plans.flows import short_reply_rows

    replies = fx.fb_reply(spark, sf)
    cut = replies.withColumn("rely_content", F.expr("substr(rely_content, 1, cast(cast(reply_id as bigint) % 9 as int))"))
    return short_reply_rows(joins.reply_with_post(replies.unionByName(cut), fx.fb_post(spark, sf)))


@register("flt_symbol_not_null", with_fixtures("select * from all_content where symbol is not null", "all_content"))
def q_flt_symbol_not_null(spark, sf):
    return fx.all_content(spark, sf).where(F.col("symbol").isNotNull())


@register("flt_event_present", with_fixtures(
    f"select * from calendar_raw where {_STRIP_SQL.format(c='event')} <> ''", "calendar_raw"))
def q_flt_event_present(spark, sf):
    return fx.calendar_raw(spark, sf).where(strip("event") != "")


def _map_sql(mapping: dict, x: str, default: str | None) -> str:
    key = lambda k: str(k) if isinstance(k, int) else f"'{k}'"
    return f"coalesce(map_extract(MAP {{{', '.join(f'{key(k)}: ' + chr(39) + v + chr(39) for k, v in mapping.items())}}}, {x})[1], {'null' if default is None else chr(39) + default + chr(39)})"


_RAW_LABELS = [*MODEL_LABEL_MAP, "surprise", "NEGATIVE"]
_RAW_SQL = "[" + ", ".join(f"'{x}'" for x in _RAW_LABELS) + f"][doc_id % {len(_RAW_LABELS)} + 1]"
_CASE_LABEL_SQL = f"""select doc_id, pred_label, {_map_sql(CUSTOM_LABEL_MAP, 'pred_label', NEUTRAL)} as sentiment, raw, {_map_sql(MODEL_LABEL_MAP, 'raw', None)} as english,
    {_map_sql(CLASS_ID_LABEL_MAP, 'doc_id % 6', 'NEUTRAL')} as of_class, {_map_sql(EN_TO_VI_LABEL_MAP, _map_sql(MODEL_LABEL_MAP, 'raw', None), NEUTRAL)} as vietnamese,
    {_map_sql(VI_TO_EN_LABEL_MAP, _map_sql(CUSTOM_LABEL_MAP, 'pred_label', NEUTRAL), 'neutral')} as training
    from (select *, {_RAW_SQL} as raw from predictions)"""


@register("prj_case_label", with_fixtures(_CASE_LABEL_SQL, "predictions"))
def q_prj_case_label(spark, sf):
    """All five label maps, with labels that a map does not hold."""
    from tickpulse.operators.sentiment import map_label

    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW_LABELS]), (F.col("doc_id") % len(_RAW_LABELS) + 1).cast("int"))
    p = fx.predictions(spark, sf).withColumn("raw", raw)
    sentiment, english = map_label("pred_label", CUSTOM_LABEL_MAP, NEUTRAL), map_label("raw", MODEL_LABEL_MAP, None)
    return p.select(
        "doc_id", "pred_label", sentiment.alias("sentiment"), "raw", english.alias("english"),
        map_label((F.col("doc_id") % 6).cast("int"), CLASS_ID_LABEL_MAP, "NEUTRAL").alias("of_class"),
        map_label(english, EN_TO_VI_LABEL_MAP, NEUTRAL).alias("vietnamese"),
        map_label(sentiment, VI_TO_EN_LABEL_MAP, "neutral").alias("training"))


@register("prj_default_fill", with_fixtures(
    """select text, label, coalesce(nullif(stock_code, ''), '') as stock_code, coalesce(has_stock, false) as has_stock,
        cast(null as double) as confidence from labelled""", "labelled"))
def q_prj_default_fill(spark, sf):
    from tickpulse.operators.training import export_columns

    lab = fx.labelled(spark, sf).select("text", "label", F.nullif("stock_code", F.lit("")).alias("stock_code"),
                                        "has_stock")
    return export_columns(lab, ["text", "label", "stock_code", "has_stock", "confidence"],
                          defaults={"stock_code": "", "has_stock": False})


@register("prj_validate_symbol", with_fixtures(
    """select id, symbol, nullif(regexp_replace(upper(regexp_replace(symbol, '^\\s+|\\s+$', '', 'g')),
        '[^A-Z0-9]', '', 'g'), '') as safe_symbol from rumors""", "rumors"))
def q_prj_validate_symbol(spark, sf):
    r = fx.rumors(spark, sf)
    return r.select("id", "symbol", validate_symbol("symbol").alias("safe_symbol"))


# ---------------------------------------------------------------- 2.4 joins
DONE_SQL = f"""select platform as source, content from posts where "timestamp" < {SPLIT_NEW}"""


def _done(spark, sf):
    p = fx.posts(spark, sf)
    return p.where(F.col("timestamp") < SPLIT_NEW).select(F.col("platform").alias("source"), "content")


@register("join_anti_processed_content", with_fixtures(
    """select * from posts p where not exists (select 1 from done d where d.content = p.content and d.source = p.platform)""",
    "posts", extra=[("done", DONE_SQL)]))
def q_join_anti_processed_content(spark, sf):
    return joins.anti_processed_content(fx.posts(spark, sf), _done(spark, sf))


REPLY_SUMMARY_SQL = f"""select r.reply_id, r.post_id from fb_reply r join fb_post p on r.post_id = p.post_id
    where p."timestamp" < {SPLIT_NEW}"""


def _reply_summary(spark, sf):
    r = joins.reply_with_post(fx.fb_reply(spark, sf), fx.fb_post(spark, sf))
    return r.where(F.col("timestamp") < SPLIT_NEW).select("reply_id", "post_id")


@register("join_anti_processed_reply", with_fixtures(
    "select * from fb_reply r where not exists (select 1 from rs where rs.reply_id = r.reply_id)",
    "fb_reply", "fb_post", extra=[("rs", REPLY_SUMMARY_SQL)]))
def q_join_anti_processed_reply(spark, sf):
    return joins.anti_processed_reply(fx.fb_reply(spark, sf), _reply_summary(spark, sf))


@register("join_anti_processed_rumor", with_fixtures(
    "select * from rumors r where not exists (select 1 from rumor_analyst a where a.processed_from_rumor_id = r.id)",
    "rumors", "rumor_analyst"))
def q_join_anti_processed_rumor(spark, sf):
    return joins.anti_processed_rumor(fx.rumors(spark, sf), fx.rumor_analyst(spark, sf))


@register("join_reply_post", with_fixtures(
    'select r.post_id, r.reply_id, r.rely_content, p."timestamp" from fb_reply r join fb_post p on r.post_id = p.post_id',
    "fb_reply", "fb_post"))
def q_join_reply_post(spark, sf):
    return joins.reply_with_post(fx.fb_reply(spark, sf), fx.fb_post(spark, sf))


@register("explode_tagged_symbols", with_fixtures(
    """select post_id, unnest(from_json(tagged_symbols, '[{"symbol":"VARCHAR"}]')).symbol as symbol from fireant_posts""",
    "fireant_posts"))
def q_explode_tagged_symbols(spark, sf):
    return joins.explode_tags(fx.fireant_posts(spark, sf))


@register("topk_rumor_queue", with_fixtures(
    """select * from rumors r where not exists (select 1 from rumor_analyst a where a.processed_from_rumor_id = r.id)
    order by "timestamp" desc, id limit 100""", "rumors", "rumor_analyst"))
def q_topk_rumor_queue(spark, sf):
    q = joins.anti_processed_rumor(fx.rumors(spark, sf), fx.rumor_analyst(spark, sf))
    return q.orderBy(F.desc("timestamp"), F.asc("id")).limit(100)


@register("limit_batch", with_fixtures(
    """select * from posts p where not exists (select 1 from done d where d.content = p.content and d.source = p.platform)
    order by "timestamp", post_id limit 1000""", "posts", extra=[("done", DONE_SQL)]))
def q_limit_batch(spark, sf):
    q = joins.anti_processed_content(fx.posts(spark, sf), _done(spark, sf))
    return q.orderBy("timestamp", "post_id").limit(1000)


@register("join_scalar_latest", with_fixtures(
    """select * from ss where "interval" = '24h' and "timestamp" = (select max("timestamp") from ss where "interval" = '24h')""",
    "all_content", extra=[("ss", _stock_sql("24h", B24) + " union all " + _stock_sql("24h", interval_bounds("24h", RUN - _dt.timedelta(days=1))))]))
def q_join_scalar_latest(spark, sf):
    ac = fx.all_content(spark, sf)
    ss = rollup.stock_sentiment(ac, "24h", RUN).unionByName(rollup.stock_sentiment(ac, "24h", RUN - _dt.timedelta(days=1)))
    return rollup.latest_of_interval(ss, "24h")


@register("agg_processing_stats", with_fixtures(
    """select (select count(*) from rumors) as total_rumors,
        (select count(distinct processed_from_rumor_id) from rumor_analyst) as processed_rumors,
        case when (select count(*) from rumors) > 0 then
            (select count(distinct processed_from_rumor_id) from rumor_analyst) / (select count(*) from rumors) * 100.0
        else 0.0 end as processing_rate""", "rumors", "rumor_analyst"))
def q_agg_processing_stats(spark, sf):
    return rollup.processing_stats(fx.rumors(spark, sf), fx.rumor_analyst(spark, sf))


@register("flow_daily_statistics", with_fixtures(
    _DAILY_SQL + " union all select * from stats",
    "all_content",
    extra=[("stats", f'select * from ({_STATS_DAYS_SQL.format(src="all_content")}) where "timestamp" < {DAY[0]}')]))
def q_flow_daily_statistics(spark, sf):
    """Daily statistics computed and upserted into a statistics table holding earlier days."""
    ac = fx.all_content(spark, sf)
    existing = rollup.daily_statistics_all_days(ac).where(F.col("timestamp") < DAY[0])
    return upsert.upsert(existing, rollup.daily_statistics(ac, RUN), ["timestamp"], "update")


@register("flow_stock_sentiment", with_fixtures(
    """select symbol, "interval", positive, negative, neutral, total, cast(null as bigint) as row_num, "timestamp"
       from ss
       union all
       select symbol, "interval", positive, negative, neutral, total, row_number() over (order by total desc, symbol),
              "timestamp" from (select * from ss where "interval" = '24h' order by total desc, symbol limit 10)""",
    "all_content",
    extra=[("ss", _stock_sql("24h", B24) + " union all " + _stock_sql("week", BWEEK) + " union all "
            + _stock_sql("month", BMONTH))]))
def q_flow_stock_sentiment(spark, sf):
    from tickpulse.plans.flows import stock_sentiment_job

    return stock_sentiment_job(fx.all_content(spark, sf), RUN)


# ---------------------------------------------------------------- 2.2 sinks and 2.8 set ops
_AC_OLD = f'select * from all_content where "timestamp" < {SPLIT_OLD}'
_AC_NEW = f'select * from all_content where "timestamp" >= {SPLIT_NEW}'


def committed(rows, name: str, keys: list[str]):
    """A committed table over ``rows`` in the shared folder."""
    from tickpulse.session import scratch_path
    from tickpulse.tables.bucket_table import BucketTable

    return BucketTable.of(rows, scratch_path(rows.sparkSession, name), keys)


def _ac_halves(spark, sf):
    ac = fx.all_content(spark, sf)
    return ac.where(F.col("timestamp") < SPLIT_OLD), ac.where(F.col("timestamp") >= SPLIT_NEW)


@register("set_union_all", with_fixtures(f"{_AC_OLD} union all {_AC_NEW}", "all_content"))
def q_set_union_all(spark, sf):
    old, new = _ac_halves(spark, sf)
    return old.unionByName(new)


@register("dedup_unique_key", with_fixtures(
    """select * exclude (rn) from (select *, row_number() over (partition by "timestamp", content order by id) as rn
        from all_content) where rn = 1""", "all_content"))
def q_dedup_unique_key(spark, sf):
    return upsert.dedup_batch(fx.all_content(spark, sf), ["timestamp", "content"], ["id"], keep="first")


@register("sink_insert_unique", with_fixtures(
    f"""select * from ex union all
        select * exclude (rn) from (select *, row_number() over (partition by "timestamp", content order by id) as rn from inc) i
        where rn = 1 and not exists (select 1 from ex e where e."timestamp" = i."timestamp" and e.content = i.content)""",
    "all_content", extra=[("ex", _AC_OLD), ("inc", _AC_NEW)]))
def q_sink_insert_unique(spark, sf):
    """Written: the old rows are a committed table, the new ones are merged into it, and the new version is read back."""
    old, new = _ac_halves(spark, sf)
    table = committed(old, "all-content", ["timestamp", "content"])
    table.merge(new, "ignore", ["id"])
    return table.read()


_RS_EX = f"""select r.reply_id, r.post_id, cast(null as varchar) as stock_id, 'TRUNG_TÍNH' as cam_xuc, p."timestamp"
    from fb_reply r join fb_post p on r.post_id = p.post_id where p."timestamp" < {SPLIT_OLD}"""
_RS_IN = f"""select r.reply_id, r.post_id, 'S01' as stock_id, 'TÍCH_CỰC' as cam_xuc, p."timestamp"
    from fb_reply r join fb_post p on r.post_id = p.post_id where p."timestamp" >= {SPLIT_NEW}"""


@register("sink_replace_by_key", with_fixtures(
    "select * from ex e where not exists (select 1 from inc i where i.reply_id = e.reply_id) union all select * from inc",
    "fb_reply", "fb_post", extra=[("ex", _RS_EX), ("inc", _RS_IN)]))
def q_sink_replace_by_key(spark, sf):
    r = joins.reply_with_post(fx.fb_reply(spark, sf), fx.fb_post(spark, sf))
    ex = r.where(F.col("timestamp") < SPLIT_OLD).select("reply_id", "post_id", F.lit(None).cast("string").alias("stock_id"),
                                                         F.lit(NEUTRAL).alias("cam_xuc"), "timestamp")
    inc = r.where(F.col("timestamp") >= SPLIT_NEW).select("reply_id", "post_id", F.lit("S01").alias("stock_id"),
                                                           F.lit("TÍCH_CỰC").alias("cam_xuc"), "timestamp")
    table = committed(ex, "reply-summary", ["reply_id"])
    table.merge(inc, "replace")
    return table.read()


@register("sink_stats_upsert", with_fixtures(
    "select * from ex e where not exists (select 1 from inc i where i.\"timestamp\" = e.\"timestamp\") union all select * from inc",
    "all_content", extra=[
        ("ex", f'select * from ({_STATS_DAYS_SQL.format(src="all_content")}) where "timestamp" < {SPLIT_OLD}'),
        ("nn", f"select * from all_content where sentiment <> 'TRUNG_TÍNH' and \"timestamp\" >= {SPLIT_NEW}"),
        ("inc", _STATS_DAYS_SQL.format(src="nn"))]))
def q_sink_stats_upsert(spark, sf):
    ac = fx.all_content(spark, sf)
    ex = rollup.daily_statistics_all_days(ac).where(F.col("timestamp") < SPLIT_OLD)
    inc = rollup.daily_statistics_all_days(ac.where((F.col("sentiment") != NEUTRAL) & (F.col("timestamp") >= SPLIT_NEW)))
    return upsert.upsert(ex, inc, ["timestamp"], "update")


_PREV_RUN = RUN - _dt.timedelta(days=1)
_B24_PREV = interval_bounds("24h", _PREV_RUN)
_NN = "(select * from all_content where sentiment <> 'TRUNG_TÍNH')"


@register("sink_stock_sentiment_ignore", with_fixtures(
    """select * from ex union all select * from inc i where not exists (select 1 from ex e
        where e.symbol = i.symbol and e."interval" = i."interval" and e."timestamp" = i."timestamp")""",
    "all_content", extra=[
        ("ex", _stock_sql("24h", _B24_PREV) + " union all " + _stock_sql("week", BWEEK)),
        ("inc", (_stock_sql("24h", B24) + " union all " + _stock_sql("24h", _B24_PREV)).replace("from all_content", f"from {_NN}"))]))
def q_sink_stock_sentiment_ignore(spark, sf):
    ac = fx.all_content(spark, sf)
    nn = ac.where(F.col("sentiment") != NEUTRAL)
    ex = rollup.stock_sentiment(ac, "24h", _PREV_RUN).unionByName(rollup.stock_sentiment(ac, "week", RUN))
    inc = rollup.stock_sentiment(nn, "24h", RUN).unionByName(rollup.stock_sentiment(nn, "24h", _PREV_RUN))
    return upsert.upsert(ex, inc, ["symbol", "interval", "timestamp"], "ignore")


def _top_sql(src: str, n: int) -> str:
    return f"""select symbol, "interval", positive, negative, neutral, total,
        row_number() over (order by total desc, symbol) as row_num, "timestamp" as updated_at
        from (select * from ({src}) order by total desc, symbol limit {n})"""


@register("sink_top_upsert", with_fixtures(
    """select * from ex e where not exists (select 1 from inc i where i."interval" = e."interval" and i.row_num = e.row_num)
        union all select * from inc""",
    "all_content", extra=[("ex", _top_sql(_stock_sql("24h", _B24_PREV), 10)), ("inc", _top_sql(_stock_sql("24h", B24), 5))]))
def q_sink_top_upsert(spark, sf):
    ac = fx.all_content(spark, sf)
    ex = rollup.top_stocks(rollup.stock_sentiment(ac, "24h", _PREV_RUN), "24h", 10)
    inc = rollup.top_stocks(rollup.stock_sentiment(ac, "24h", RUN), "24h", 5)
    return upsert.upsert_ranks(ex, inc, ["interval", "row_num"])
