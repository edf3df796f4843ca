"""Registered queries: text, ticker, sentence, date and JSON functions (inventory 2.9, 2.10)."""

from __future__ import annotations

import datetime as dt
import inspect
import re
import unicodedata

from pyspark.sql import functions as F

from tickpulse.constants import CONTEXT_VETO_WORDS, GENERAL_KEY, RUMOR_PATTERNS
from tickpulse.functions import sentences as fs
from tickpulse.functions import text as ft
from tickpulse.functions import tickers as tk
from tickpulse.functions.rumor_rules import (accept_rewrite, rewrite_post, rewrite_rules, rumor_pattern,
                                             whole_word_patterns)
from tickpulse.functions.timewin import epoch_seconds, floor_to, normalize_calendar_date, to_zone, ts_of_epoch
from tickpulse.operators.training import stock_tag
from tickpulse.plans import oracle_text as ot
from tickpulse.plans.oracle_fixtures import with_fixtures
from tickpulse.plans.registry import register as _register
from tickpulse.sources import fixtures as fx

DICT = tk.TickerDictionary(sorted(fx.TEST_TICKERS))
# FIXED VALUES: cue words standing in for the rumor patterns on the non-Vietnamese test text
TEST_CUE_WORDS = ["that", "was", "und"]
TEST_PATTERNS = whole_word_patterns(TEST_CUE_WORDS)


# Literal rows beside the documents, so that every rule bites in both engines: one text per rumor cue (the next two hold two
# cues), a veto word on either side of a ticker, decomposed accents, entities, links, short texts.
CUE_TEXTS = [
    "Tôi nghe đồn là FPT lên", "họ đồn rằng giá giảm", "có tin đồn rằng lãi", "theo lời đồn thì tốt", "người ta nói là lỗ",
    "có nguồn tin rằng bán", "nhiều người nói vậy", "có người cho rằng mua", "cả nhóm xì xào", "tin vỉa hè thôi",
    "tin chưa kiểm chứng", "chưa có căn cứ gì", "Hình như tăng", "nghe bảo thế", "nghe kể lại", "được cho là lớn",
    "có vẻ như giảm", "có khả năng là đúng", "tin nội bộ nhé", "tin rò rỉ ra", "có lời đồn mới", "có người truyền tai nhau",
    "đồn đại phát sinh", "đồn đại nhiều", "đồn thổi mãi", "a rumor here", "pure hearsay", "Word on the street is up",
    "people say so", "sources say no", "allegedly true", "reportedly sold", "unconfirmed news", "mere speculation", "a whisper",
    "it is said", "according to rumors", "gossip only", "rumor has it", "reportedly a rumour", "THEO LỜI ĐỒN, hình như thế",
]
_OTHER_TEXTS = [
    *[f"hôm nay {w} IT tăng mạnh" for w in CONTEXT_VETO_WORDS], *[f"mua IT {w} ngay" for w in CONTEXT_VETO_WORDS],
    "IT dẫn đầu, AI theo sau", "it và ai không phải mã", unicodedata.normalize("NFD", "Cổ phiếu tăng trưởng ổn định"),
    "A&amp;B &lt;x&gt; &quot;q&quot; it&#39;s", "xem http://a.b/c @user #tag ngay!!!", "hearsays rumorous gossipy", "ok", "",
    "Giá cổ phiếu tăng 5% hôm nay. Nhà đầu tư mua mạnh trên thị trường trong phiên sáng. Lợi nhuận quý này đạt 900 tỷ đồng!",
]
LITERAL_DOCS = [(-1 - i, t) for i, t in enumerate([*CUE_TEXTS, *_OTHER_TEXTS])]
DOCS_SQL = "(select doc_id, text from documents union all select * from (values " + ", ".join(
    f"({i}, {ot.q(t)})" for i, t in LITERAL_DOCS) + ") v(doc_id, text))"
FLAGGED_DOCS = f"(select doc_id, text, {ot.common_flags('text', DICT.symbols)} from documents)"


def docs(spark, sf):
    literal = spark.createDataFrame(LITERAL_DOCS, "doc_id long, text string")
    return fx.table(spark, sf, "documents").select("doc_id", "text").unionByName(literal)


def register(name: str, sql: str | None = None):
    """Registers a query; one over ``docs`` reads the literal rows in its SQL too."""
    def deco(fn):
        over = sql is not None and "docs(spark, sf)" in inspect.getsource(fn)
        return _register(name, re.sub(r"\bfrom documents\b", lambda m: f"from {DOCS_SQL}", sql) if over else sql)(fn)

    return deco


# ---------------------------------------------------------------- cleaning / tokens
@register("fn_nfc", "select doc_id, nfc_normalize(text) as text from documents")
def q_fn_nfc(spark, sf):
    return docs(spark, sf).select("doc_id", ft.nfc("text").alias("text"))


@register("fn_tokenize", f"""select doc_id, array_to_string({ot.tokenize('text')}, ' ') as tokens,
        len({ot.tokenize('text')}) as n_tokens from documents""")
def q_fn_tokenize(spark, sf):
    t = ft.tokenize(F.col("text"))
    return docs(spark, sf).select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n_tokens"))


@register("fn_ensure_token_list", f"""select doc_id, len({ot.tokenize('text')}) as n_tokens from documents""")
def q_fn_ensure_token_list(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(ft.ensure_token_list(ft.tokenize(F.col("text")))).alias("n_tokens"))


@register("fn_explode_tokens", f"""select doc_id, t as token, count(*) as n
        from (select doc_id, unnest({ot.tokenize('text')}) as t from documents) group by doc_id, t""")
def q_fn_explode_tokens(spark, sf):
    d = docs(spark, sf).select("doc_id", F.explode(ft.tokenize(F.col("text"))).alias("token"))
    return d.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@register("fn_sentiment_clean", f"select doc_id, {ot.sentiment_clean('nfc_normalize(text)')} as cleaned from documents")
def q_fn_sentiment_clean(spark, sf):
    return docs(spark, sf).select("doc_id", ft.sentiment_clean(ft.nfc("text")).alias("cleaned"))


@register("fn_summary_clean", f"select doc_id, nfc_normalize({ot.summary_clean('text')}) as cleaned from documents")
def q_fn_summary_clean(spark, sf):
    return docs(spark, sf).select("doc_id", ft.nfc(ft.summary_clean("text")).alias("cleaned"))


@register("fn_first_paragraph", "select doc_id, string_split_regex(text, '\\n\\n+')[1] as paragraph from documents")
def q_fn_first_paragraph(spark, sf):
    return docs(spark, sf).select("doc_id", ft.first_paragraph("text").alias("paragraph"))


# ---------------------------------------------------------------- tickers
@register("fn_ticker_rules", f"""select doc_id, array_to_string({ot.rule_codes('text', DICT.symbols)}, ',') as codes
        from {FLAGGED_DOCS}""")
def q_fn_ticker_rules(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(tk.rule_codes(F.col("text"), DICT), ",").alias("codes"))


@register("fn_extract_codes", f"""select doc_id, array_to_string({ot.rule_codes('text', DICT.symbols)}, ',') as codes,
        len({ot.rule_codes('text', DICT.symbols)}) > 0 as has_mention from {FLAGGED_DOCS}""")
def q_fn_extract_codes(spark, sf):
    """The dictionary stays a table: the tickers and the listed symbols, one row per event."""
    from tickpulse.operators.joins import codes_by_table

    listed = fx.tickers(spark, sf).unionByName(fx.institution_profiles(spark, sf))
    found = codes_by_table(docs(spark, sf), "doc_id", "text", listed)
    return found.select("doc_id", F.array_join("codes", ",").alias("codes"), tk.has_mention("codes").alias("has_mention"))


@register("fn_upper_in_text", f"""select doc_id, {ot.upper_in_text('text', 'IT')} as it_upper,
        {ot.upper_in_text('text', 'AI')} as ai_upper from documents""")
def q_fn_upper_in_text(spark, sf):
    return docs(spark, sf).select("doc_id", tk.upper_in_text("text", "IT").alias("it_upper"),
                                  tk.upper_in_text("text", "AI").alias("ai_upper"))


@register("fn_ticker_context_ok", f"""select doc_id, {ot.context_ok('text', 'IT')} as it_ok from documents
        where {ot.upper_in_text('text', 'IT')}""")
def q_fn_ticker_context_ok(spark, sf):
    d = docs(spark, sf).where(tk.upper_in_text("text", "IT"))
    return d.select("doc_id", tk.context_ok("text", "IT").alias("it_ok"))


@register("join_ticker_dictionary", with_fixtures(
    f"""select doc_id, c as code from (select doc_id, unnest({ot.candidates('text')}) as c from documents) x
        join tickers t on t.symbol = x.c""", "tickers"))
def q_join_ticker_dictionary(spark, sf):
    from tickpulse.operators.joins import dictionary_hits

    return dictionary_hits(docs(spark, sf), "doc_id", "text", fx.tickers(spark))


_CANDS_SQL = "regexp_extract_all(text, '(^|[^\\p{L}\\p{N}_])([A-Z][a-z]{1,3})([^\\p{L}\\p{N}_]|$)', 2)"


_GATE_SQL = ot.candidate_gate("text", ot.title_words("text"), DICT.symbols)


@register("fn_candidate_gate", f"select doc_id, array_to_string({_GATE_SQL}, ',') as codes from {FLAGGED_DOCS}")
def q_fn_candidate_gate(spark, sf):
    """Gate applied to title-case words proposed as entities (stand-in for a NER column)."""
    d = docs(spark, sf)
    cands = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-z]{1,3}(?![\p{L}\p{N}_])"), 0)
    gated = tk.candidate_gate(F.col("text"), cands, DICT)
    return d.select("doc_id", F.array_join(gated, ",").alias("codes"))


@register("set_union_codes", f"""select doc_id, array_to_string(case when length({ot.strip('text')}) >= 5 then
        list_sort(list_distinct(list_concat({ot.rule_codes('text', DICT.symbols)}, {_GATE_SQL}))) else [] end, ',') as codes
        from {FLAGGED_DOCS}""")
def q_set_union_codes(spark, sf):
    d = docs(spark, sf)
    cands = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-z]{1,3}(?![\p{L}\p{N}_])"), 0)
    return d.select("doc_id", F.array_join(tk.extract_codes(F.col("text"), DICT, cands), ",").alias("codes"))


_SYMCSV_SQL = """(case when text is null or text = '' then null else nullif(array_to_string(list_sort(list_distinct(
        list_filter(regexp_extract_all(upper(text), '[\\p{L}\\p{N}_]+'), lambda w: list_contains(%s, w)))), ','), '') end)""" % ot.lst(DICT.symbols)


@register("fn_symbols_csv", f"select doc_id, {_SYMCSV_SQL} as symbols from documents")
def q_fn_symbols_csv(spark, sf):
    return docs(spark, sf).select("doc_id", tk.symbols_csv("text", DICT).alias("symbols"))


@register("set_sorted_distinct_join", with_fixtures(
    f"select id, {_SYMCSV_SQL.replace('text', 'content')} as symbol from zalo_chat", "zalo_chat"))
def q_set_sorted_distinct_join(spark, sf):
    z = fx.zalo_chat(spark, sf)
    return z.select("id", tk.symbols_csv("content", DICT).alias("symbol"))


ALL_PATTERNS = [*RUMOR_PATTERNS, *TEST_PATTERNS]


def pattern_sql(x):
    out = "null"
    for pat in reversed(ALL_PATTERNS):
        body = pat.removeprefix(r"\b").removesuffix(r"\b")
        out = f"case when regexp_matches(low, {ot.q(f'(^|[^{ot.W}])(?:{body})([^{ot.W}]|$)')}) then {ot.q(pat)} else {out} end"
    return f"case when {x} is null or {x} = '' then null else {out} end"


@register("fn_rumor_pattern", f"select doc_id, {pattern_sql('text')} as matched_keyword from (select *, lower(text) as low from documents)")
def q_fn_rumor_pattern(spark, sf):
    return docs(spark, sf).select("doc_id", rumor_pattern("text", ALL_PATTERNS).alias("matched_keyword"))


# ---------------------------------------------------------------- sentences
_SENTS = ot.split_sentences("text")


@register("fn_split_sentences", f"""select doc_id, len({_SENTS}) as n_sentences, array_to_string({_SENTS}, ' | ') as sentences
        from documents""")
def q_fn_split_sentences(spark, sf):
    s = fs.split_sentences("text")
    return docs(spark, sf).select("doc_id", F.size(s).alias("n_sentences"), F.array_join(s, " | ").alias("sentences"))


@register("fn_sentence_score", f"""select doc_id, pos, {ot.sentence_score('s', "'THE'")} as score
        from (select doc_id, unnest({_SENTS}) as s, generate_subscripts({_SENTS}, 1) as pos from documents)""")
def q_fn_sentence_score(spark, sf):
    d = docs(spark, sf).select("doc_id", F.posexplode(fs.split_sentences("text")).alias("p", "s"))
    return d.select("doc_id", (F.col("p") + 1).alias("pos"), fs.sentence_score("s", F.lit("THE")).alias("score"))


@register("win_sentence_context", f"""select doc_id, pos, {ot.context_at('ss', 'pos')} as context
        from (select doc_id, ss, unnest(range(1, len(ss) + 1)) as pos from (select doc_id, {_SENTS} as ss from documents))""")
def q_win_sentence_context(spark, sf):
    d = docs(spark, sf).select("doc_id", fs.split_sentences("text").alias("ss"))
    d = d.select("doc_id", "ss", F.explode(F.sequence(F.lit(1), F.size("ss"))).alias("pos"))
    return d.select("doc_id", "pos", fs.context_of("ss", F.col("pos")).alias("context"))


_CODES_SQL = ot.rule_codes("text", DICT.symbols)


_BEST = ot.best_sentences(FLAGGED_DOCS, _SENTS, _CODES_SQL, DICT.symbols)


@register("fn_important_sentence", f"""select doc_id, code, case when best_pos is null then ''
        else {ot.context_at('ss', 'list_position(ss, ss[best_pos])')} end as sentence from ({_BEST})
        union all select doc_id, {ot.q(GENERAL_KEY)} as code, text as sentence from {FLAGGED_DOCS}
        where text <> '' and len({_CODES_SQL}) = 0""")
def q_fn_important_sentence(spark, sf):
    pairs = fs.extract_important_sentences("text", tk.rule_codes(F.col("text"), DICT))
    d = docs(spark, sf).select("doc_id", F.explode(pairs).alias("p"))
    return d.select("doc_id", F.col("p.symbol").alias("code"), F.col("p.sentence").alias("sentence"))


@register("win_best_sentence", f"select doc_id, code, best_pos from ({_BEST})")
def q_win_best_sentence(spark, sf):
    pairs = fs.best_sentence_positions(fs.split_sentences("text"), tk.rule_codes(F.col("text"), DICT))
    d = docs(spark, sf).select("doc_id", F.explode(pairs).alias("p"))
    return d.select("doc_id", F.col("p.symbol").alias("code"), F.col("p.best_pos").cast("bigint").alias("best_pos"))


@register("fn_truncate", f"select doc_id, {ot.truncate('text', 100)} as truncated from documents")
def q_fn_truncate(spark, sf):
    return docs(spark, sf).select("doc_id", fs.truncate_text("text", 100).alias("truncated"))


@register("fn_split_by_capital", f"""select doc_id, len(parts) as n_parts, array_to_string(parts, ' | ') as parts
        from {ot.split_by_capital('documents', 'doc_id', 'text')}""")
def q_fn_split_by_capital(spark, sf):
    s = fs.split_by_capital("text")
    return docs(spark, sf).select("doc_id", F.size(s).alias("n_parts"), F.array_join(s, " | ").alias("parts"))


@register("fn_smart_summary", ot.smart_summary("documents", ot.summary_clean("text"), 100)[1:-1])
def q_fn_smart_summary(spark, sf):
    return docs(spark, sf).select("doc_id", fs.smart_summary("text", 100).alias("summary"))


_FIRST = f"(select doc_id, ct, {ot.split_sentences('ct')}[1] as first from (select doc_id, {ot.summary_clean('text')} as ct from documents))"
_LABEL_FREE = r"regexp_replace(first, '(?i)\b(vietnews|tóm tắt|summary):?\s*', '', 'g')"


@register("fn_summary_post", f"""select a.doc_id, case when {ot.word_count('s')} < 5 then b.summary when regexp_matches(s, '[.!?]$') then s
        else regexp_replace(s, '\\s+$', '') || '.' end as summary
    from (select *, {_LABEL_FREE} as s from {_FIRST}) a
    join {ot.smart_summary(_FIRST, ot.summary_clean('ct'), 100)} b on b.doc_id = a.doc_id""")
def q_fn_summary_post(spark, sf):
    """Post-processing applied to a first-sentence 'model summary' of each document."""
    d = docs(spark, sf).withColumn("_c", ft.summary_clean("text"))
    first = F.element_at(fs.split_sentences("_c"), 1)
    return d.select("doc_id", fs.summary_post_process(first, F.col("_c")).alias("summary"))


# ---------------------------------------------------------------- rewriting
# literal rows that hit each branch of the rules, next to the table's pairs
_CUES = [(-1, "Nghe đồn FPT sắp chia cổ tức 20%!", ""), (-2, "Tôi nghe  nói vậy, nghe nói HPG (thép) lỗ", None),
         (-3, "Hình như VNM tăng; có vẻ như mạnh", "hình như VNM tăng; có vẻ như mạnh"), (-4, "không có gì", "  kết quả   mới"),
         (-5, "CÓ VẺ NHƯ thị trường yên", " CÓ VẺ NHƯ thị trường yên "), (-6, "giá vàng", "đã xong?")]
_PAIRS_SQL = "(select pair_id, original, rewritten from rewrite_pairs union all select * from (values " + ", ".join(
    f"({i}, {ot.q(o)}, {'null' if r is None else ot.q(r)})" for i, o, r in _CUES) + ") v(pair_id, original, rewritten))"


def _rewrite_rows(spark, sf):
    cues = spark.createDataFrame(_CUES, "pair_id long, original string, rewritten string")
    return fx.rewrite_pairs(spark, sf).select("pair_id", "original", "rewritten").unionByName(cues)


@register("fn_rewrite_rules", with_fixtures(f"select pair_id, {ot.rewrite_rules('original')} as rewritten from {_PAIRS_SQL}", "rewrite_pairs"))
def q_fn_rewrite_rules(spark, sf):
    return _rewrite_rows(spark, sf).select("pair_id", rewrite_rules("original").alias("rewritten"))


@register("fn_rewrite_post", with_fixtures(f"select pair_id, {ot.rewrite_post('rewritten', 'original')} as rewritten from {_PAIRS_SQL}", "rewrite_pairs"))
def q_fn_rewrite_post(spark, sf):
    return _rewrite_rows(spark, sf).select("pair_id", rewrite_post("rewritten", "original").alias("rewritten"))


@register("fn_rewrite_accept", with_fixtures(
    f"""select pair_id, case when rewritten is null or length({ot.strip('rewritten')}) < 3 then original else rewritten end
        as accepted from rewrite_pairs""", "rewrite_pairs"))
def q_fn_rewrite_accept(spark, sf):
    p = fx.rewrite_pairs(spark, sf)
    return p.select("pair_id", accept_rewrite("rewritten", "original").alias("accepted"))


@register("fn_stock_tag", with_fixtures(
    """select doc_id, case when stock_code is not null and stock_code <> '' then '[STOCK]' || stock_code || '[/STOCK] ' || text
        else text end as model_text from labelled""", "labelled"))
def q_fn_stock_tag(spark, sf):
    return fx.labelled(spark, sf).select("doc_id", stock_tag("text", "stock_code").alias("model_text"))


# ---------------------------------------------------------------- dates / json
@register("fn_ts_to_epoch", """select event_id, cast(floor(epoch(ts)) as bigint) as epoch from events""")
def q_fn_ts_to_epoch(spark, sf):
    return fx.events(spark, sf).select("event_id", epoch_seconds("ts").alias("epoch"))


@register("fn_epoch_to_ts", with_fixtures(
    """select id, strftime(make_timestamp("timestamp" * 1000000), '%Y-%m-%d %H:%M:%S') as ts from all_content""",
    "all_content"))
def q_fn_epoch_to_ts(spark, sf):
    ac = fx.all_content(spark, sf)
    return ac.select("id", F.date_format(ts_of_epoch("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@register("fn_tz_convert", """select event_id, strftime(ts + interval 7 hour, '%Y-%m-%d %H:%M:%S') as local_ts from events""")
def q_fn_tz_convert(spark, sf):
    e = fx.events(spark, sf)
    return e.select("event_id", F.date_format(to_zone("ts", "Asia/Bangkok"), "yyyy-MM-dd HH:mm:ss").alias("local_ts"))


@register("fn_floor_hour", """select event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour_ts,
        strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute_ts from events""")
def q_fn_floor_hour(spark, sf):
    e = fx.events(spark, sf)
    return e.select("event_id", F.date_format(floor_to("ts", "hour"), "yyyy-MM-dd HH:mm:ss").alias("hour_ts"),
                    F.date_format(floor_to("ts", "minute"), "yyyy-MM-dd HH:mm:ss").alias("minute_ts"))


@register("fn_day_anchor", """select event_id,
        strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as midnight,
        strftime(date_trunc('day', ts) + interval 7 hour, '%Y-%m-%d %H:%M:%S') as seven_am,
        strftime(date_trunc('day', ts) + interval 8 hour, '%Y-%m-%d %H:%M:%S') as eight_am from events""")
def q_fn_day_anchor(spark, sf):
    e = fx.events(spark, sf)
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return e.select("event_id", F.date_format(day, fmt).alias("midnight"),
                    F.date_format(day + F.expr("INTERVAL 7 HOURS"), fmt).alias("seven_am"),
                    F.date_format(day + F.expr("INTERVAL 8 HOURS"), fmt).alias("eight_am"))


@register("fn_week_start", """select event_id, strftime(date_trunc('day', ts) + interval 8 hour
        - to_days(cast(isodow(ts) - 1 + 7 as integer)), '%Y-%m-%d %H:%M:%S') as week_start from events""")
def q_fn_week_start(spark, sf):
    e = fx.events(spark, sf)
    day8 = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 8 HOURS")
    wd = F.weekday("ts")  # 0 = Monday
    start = F.timestamp_add("DAY", -(wd + 7), day8)
    return e.select("event_id", F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("week_start"))


@register("fn_normalize_date", with_fixtures(
    """select row_idx, date as raw_date, case when regexp_replace(date, '\\s', '', 'g') = '' then ''
        else strftime(strptime(regexp_replace(date, '^\\S+\\s+', '') || ' 2024', '%b %d %Y'), '%Y-%m-%d') end as event_date,
        case when regexp_replace(date, '\\s', '', 'g') = '' then '' else strftime(strptime(regexp_replace(date, '^\\S+\\s+', '') || ' 2031', '%b %d %Y'), '%Y-%m-%d')
        end as from_december from calendar_raw""", "calendar_raw"))
def q_fn_normalize_date(spark, sf):
    c = fx.calendar_raw(spark, sf)
    return c.select("row_idx", F.col("date").alias("raw_date"),
                    normalize_calendar_date(F.col("date"), fx.RUN_TIME).alias("event_date"),
                    # January headers seen in December 2030 are those of the next year
                    normalize_calendar_date(F.col("date"), dt.datetime(2030, 12, 20)).alias("from_december"))


@register("fn_json_symbols", with_fixtures(
    """select post_id, json_extract_string(tagged_symbols, '$[0].symbol') as first_symbol from fireant_posts""",
    "fireant_posts"))
def q_fn_json_symbols(spark, sf):
    f = fx.fireant_posts(spark, sf)
    return f.select("post_id", F.get_json_object("tagged_symbols", "$[0].symbol").alias("first_symbol"))


@register("fn_argmax_softmax", """select vec_id, list_position(p, list_max(p)) - 1 as pred, round(list_max(p), 9) as confidence
        from (select vec_id, list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e))))) as p
              from (select vec_id, list_transform(embedding[1:3], lambda v: cast(v as double)) as e from embeddings))""")
def q_fn_argmax_softmax(spark, sf):
    from tickpulse.operators.training import softmax_argmax

    e = fx.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("logits"))
    return softmax_argmax(e, "logits").select("vec_id", "pred", F.round("confidence", 9).alias("confidence"))


@register("fn_floor_minute", """select event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute_ts from events""")
def q_fn_floor_minute(spark, sf):
    e = fx.events(spark, sf)
    return e.select("event_id", F.date_format(floor_to("ts", "minute"), "yyyy-MM-dd HH:mm:ss").alias("minute_ts"))
