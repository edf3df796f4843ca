"""One test for each case that once went wrong."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import one_col
from tickpulse.functions import text as ft
from tickpulse.functions.tickers import TickerDictionary, extract_codes
from tickpulse.operators import training, trending, upsert
from tickpulse.operators.sentiment import PandasScorer, transform_sentiment
from tickpulse.plans import flows
from tickpulse.session import scratch_path
from tickpulse.streaming import streams

DAYS = 220


@pytest.fixture
def many_writers(spark):
    """Several writer tasks per micro-batch, as on a cluster."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def arrived(df):
    """The rows as files in a source folder, and a fresh state folder: what the streams take."""
    source, state = scratch_path(df.sparkSession, "source"), scratch_path(df.sparkSession, "state")
    df.write.parquet(source)
    return df.sparkSession, source, df.schema, state


def epoch(day, second):
    return 1_600_000_000 + day * 86400 + second


def test_streams_keep_every_row_of_a_long_history(spark, many_writers):
    rows = [(epoch(d, 7 * i), "FPT" if i % 2 else "HPG", ["TÍCH_CỰC", "TIÊU_CỰC", "TRUNG_TÍNH", None][i % 4]) for d in range(DAYS) for i in range(4)]
    facts = spark.createDataFrame(rows, "timestamp long, symbol string, sentiment string").repartition(30)
    got = streams.tumbling_stock_sentiment(*arrived(facts), options={"maxFilesPerTrigger": 8}).collect()
    assert sum(r.total for r in got) == len(rows) and len(got) == 2 * DAYS
    assert sum(r.positive for r in got) == sum(r.negative for r in got) == sum(r.neutral for r in got) == DAYS


def test_sliding_counts_equal_the_batch_counts(spark, many_writers):
    base = dt.datetime(2023, 1, 1)
    rows = [(base + dt.timedelta(days=d, minutes=i), f"word{i} common") for d in range(DAYS) for i in range(2)]
    texts = spark.createDataFrame(rows, "ts timestamp_ntz, text string").repartition(30)
    got = {(r.window_start, r.token): r.n for r in streams.sliding_tokens(*arrived(texts), "ts", "text", options={"maxFilesPerTrigger": 8}).collect()}
    want = {}
    for ts, text in rows:
        hour = ts.replace(minute=0)
        for w in text.split():
            for k in range(24):
                key = (hour - dt.timedelta(hours=k), w)
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_incremental_posts_equal_the_batch_flow(spark, many_writers):
    d = TickerDictionary(["FPT", "HPG"])
    rows = [(f"p{n}-{i}", f"Hôm nay FPT tăng mạnh lần {n % 50}.", epoch(n, 0) if i else epoch(n % 9, 0), "facebook" if i else "zalo_chat") for n in range(DAYS) for i in range(2)]
    posts = spark.createDataFrame(rows, "post_id string, content string, timestamp long, platform string").repartition(20)
    got = sorted(tuple(r) for r in streams.incremental_posts(*arrived(posts), d, options={"maxFilesPerTrigger": 8}).collect())
    want = sorted(tuple(r) for r in flows.process_posts(posts, d).collect())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want] and len(got) > DAYS


def test_one_post_on_two_platforms_is_one_row(spark):
    posts = spark.createDataFrame([("a", "short", 5, "zalo_chat"), ("b", "short", 5, "facebook"), ("c", "short", 6, "facebook")],
                                  "post_id string, content string, timestamp long, platform string")
    got = sorted((r.timestamp, r.source) for r in flows.process_posts(posts, TickerDictionary(["FPT"])).collect())
    assert got == [(5, "facebook"), (6, "facebook")]


def test_large_integer_keys_split_and_sample(spark):
    df = spark.createDataFrame([(i * 10**15 + 4_000_000_000,) for i in range(50)], "k long")
    assert training.hash_split(df, "k").count() == 50
    assert training.sample_rows(df, "k", 7).count() == 7


def test_bins_follow_freq(spark):
    ts = lambda h, m: dt.datetime(2024, 5, 2, h, m)
    tokens = spark.createDataFrame([(ts(10, 10), "w"), (ts(10, 40), "w"), (ts(10, 41), "w"), (ts(11, 59), "w")], "ts timestamp_ntz, token string")
    words = one_col(spark, ["w"], "word")
    got = {r.bin: r["count"] for r in trending.token_bins(tokens, words, dt.datetime(2024, 5, 2, 12), "30 minutes").collect()}
    assert len(got) == 96 and {k: v for k, v in got.items() if v} == {ts(10, 0): 1, ts(10, 30): 2, ts(11, 30): 1}
    assert max(got) == ts(11, 30)


def test_one_failing_text_does_not_fail_its_batch(spark):
    def score(s: pd.Series) -> pd.DataFrame:
        if s.str.contains("boom").any():
            raise ValueError("boom")
        return pd.DataFrame({"label": ["positive"] * len(s), "score": [0.9] * len(s)})

    df = one_col(spark, ["good text one", "boom text", "good text two", "good text three"]).coalesce(1)
    got = {r.t: (r.sentiment, r.confidence, r.sentiment_source) for r in transform_sentiment(df, "t", PandasScorer(score)).collect()}
    assert got["boom text"] == ("TRUNG_TÍNH", 0.5, "Scorer failed")
    assert {v for k, v in got.items() if k != "boom text"} == {("TÍCH_CỰC", 0.9, "pandas")}


def test_all_entities_are_decoded(spark):
    row = one_col(spark, ["caf&eacute; &#8217;x&#x27; A&amp;B &lt;b&gt;", "no entity & sign"]).select(ft.html_unescape("t").alias("u")).collect()
    assert [r.u for r in row] == ["café ’x' A&B <b>", "no entity & sign"]


def test_nothing_is_cut(spark):
    assert one_col(spark, ["FPT-VN@HOSE12345"]).select(ft.validate_symbol("t").alias("s")).first().s == "FPTVNHOSE12345"
    long = "tin đồn rằng công ty sẽ " + "rất " * 1000 + "tốt"
    rumors = spark.createDataFrame([(1, long, "FPT", None, "zalo_chat", 5)], "id long, content string, symbol string, sentiment string, source string, timestamp long")
    row = flows.rewrite_rumors(rumors).first()
    assert row.original_content == long and len(row.rewritten_content) > 3900


def test_a_dictionary_of_60000_symbols(spark):
    names = [a + b + c + d for a in "BCDFGHJKLMNPQRS" for b in "ABCDEFGHIJKLMNOP" for c in "ABCDEFGHIJKLMNOP" for d in "ABCDEFGHIJKLMNOP"][:60_000]
    d = TickerDictionary.from_table(spark.createDataFrame([(x,) for x in names], "symbol string"))
    assert len(d.symbols) == 60_000
    row = one_col(spark, [f"hôm nay {names[-1]} và ZZZZ tăng"]).select(extract_codes(F.col("t"), d).alias("c")).first()
    assert row.c == [names[-1]]


def test_line_numbers_and_small_splits(spark):
    df = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "k int, v string").repartition(7)
    got = sorted((r.k, r.line_no) for r in training.with_line_numbers(df, ["k"]).collect())
    assert got == [(i, i) for i in range(101)]
    few = training.ordered_split(df.where("k < 10"), ["k"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in few} == {"train": 9, "test": 1}


def test_null_keys_need_no_common_partition(spark):
    rows = [(None, str(i % 3)) for i in range(300)] + [(1, "a"), (1, "b")]
    got = upsert.dedup_batch(spark.createDataFrame(rows, "k int, v string"), ["k"], [F.col("v")])
    assert got.count() == 301


def test_trending_bounds_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/posts"
    spark.createDataFrame([(dt.datetime(2024, 5, 2, 1), "giá vàng tăng")], "date timestamp_ntz, content string").write.parquet(path)
    plan = trending.exploded_tokens(spark.read.parquet(path), between=(dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 3)))
    text = plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(date," in text and "LessThanOrEqual(date," in text


def test_report_evaluates_its_input_once(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "true_label string, pred_label string")
    got = {r.label: (r.precision, r.recall, r.support) for r in training.classification_report(df).collect()}
    assert got["a"] == (0.5, 0.5, 2) and got["b"] == (0.5, 1.0, 1) and got["c"] == (0.0, 0.0, 1)
    m = training.weighted_metrics(df).first()
    assert m.accuracy == 0.5 and abs(m.recall - 0.5) < 1e-12
    plan = training.classification_report(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_one_page_is_filled_by_many_blocks(spark):
    from tickpulse.operators.fill import carry_down

    rows = [(1 if i < 900 else 2, i, f"v{i}" if i % 97 == 0 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, i long, v string").repartition(5)
    got = {r.i: (r.last, r.n) for r in carry_down(df, ["k"], "i", {"last": F.col("v")}, {"n": F.col("v").isNotNull()}, block=16).collect()}
    want, last, n = {}, None, 0
    for k, i, v in rows:
        if i == 900:
            last, n = None, 0
        if v is not None:
            last, n = v, n + 1
        want[i] = (last, n)
    assert got == want


@F.pandas_udf(T.ArrayType(T.StringType()))
def _codes_by_python(s: pd.Series) -> pd.Series:
    return s.map(lambda v: ["FPT"] if "FPT" in v else [])


def test_important_sentences_work_out_the_codes_once_per_post(spark):
    from tickpulse.functions import sentences as fs

    # a Python function cannot stand inside a lambda, so this runs only if the codes are no part of the work per sentence
    df = one_col(spark, ["FPT mở cửa. Mai nghỉ.", "Mai nghỉ."])
    got = df.select(fs.important_sentences(fs.split_sentences("t"), _codes_by_python("t")).alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in got] == [[("FPT", "FPT mở cửa. Mai nghỉ.")], []]


def test_a_text_without_codes_is_important_as_a_whole(spark):
    from tickpulse.functions import sentences as fs

    df = one_col(spark, ["Mai nghỉ. FPT mở cửa.", "Mai nghỉ. Thế thôi. ", " ", "", None])
    got = df.select(fs.extract_important_sentences("t", _codes_by_python(F.coalesce("t", F.lit("")))).alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in got] == [[("FPT", "Mai nghỉ. FPT mở cửa.")], [("GENERAL", "Mai nghỉ. Thế thôi. ")], [("GENERAL", " ")], [], []]
    none = df.limit(2).select(fs.extract_important_sentences("t", F.lit(None).cast("array<string>")).alias("m")).collect()
    assert [x.symbol for r in none for x in r.m] == ["GENERAL", "GENERAL"]


def test_the_query_of_important_sentences_keeps_texts_without_codes(spark, tmp_path):
    from tickpulse.plans import registry

    rows = [(1, "THE price. No more."), (2, "nothing here. At all. "), (3, ""), (4, None), (5, "ok")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.load_all()["fn_important_sentence"].build(spark, str(tmp_path)).where("doc_id > 0").collect()
    assert sorted(map(tuple, got)) == [(1, "THE", "THE price. No more."), (2, "GENERAL", "nothing here. At all. "), (5, "GENERAL", "ok")]


def test_best_sentences_work_out_the_codes_once_per_post(spark):
    from tickpulse.functions import sentences as fs

    df = one_col(spark, ["Mai nghỉ. FPT mở cửa.", "Mai nghỉ."])
    got = df.select(fs.best_sentence_positions(fs.split_sentences("t"), _codes_by_python("t")).alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in got] == [[("FPT", 2)], []]


def test_calendar_dates_are_normalised_at_their_headers_only(spark):
    rows = [(1, 0, "Sun Oct 5", "08:00", "CPI"), (1, 1, "", "", "GDP"), (1, 2, "Mon Oct 6", "", "PMI"), (2, 0, "", "09:00", "lost"), (2, 1, "soon", "", "PPI")]
    raw = spark.createDataFrame([(*r, "USD", "High", "1", "2", "3") for r in rows], "page_id long, row_idx long, date string, time string, event string, "
                                "currency string, impact string, actual string, forecast string, previous string")
    flat = flows.calendar_events(raw, dt.datetime(2025, 9, 1))
    got = sorted((r.page_id, r.row_idx, r.event_date, r.event_time) for r in flat.collect())
    assert got == [(1, 0, "2025-10-05", "08:00"), (1, 1, "2025-10-05", "08:00"), (1, 2, "2025-10-06", ""), (2, 1, "soon", "")]
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert "MMM d yyyy" not in plan[:plan.index("Window")]  # nothing is parsed above the fill


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_smart_summary_picks_its_sentences_once(spark):
    from tickpulse.functions import sentences as fs

    text = "Một hai ba bốn năm sáu bảy.  Tám chín mười mười một 5 @ai #thẻ http://x.vn/a hai. Ba bốn! Cổ phiếu tăng mạnh vào cuối ngày."
    df = one_col(spark, [text, "ngắn", "", None]).select(fs.smart_summary("t", 60).alias("s"))
    assert [r.s for r in df.collect()] == ["Một hai ba bốn năm sáu bảy.", "ngắn", "", ""]
    assert _optimized(df).count("aggregate(") == 1  # it stood three times in the expression


def test_summaries_without_a_model_clean_the_text_once(spark):
    df = flows.summarize(one_col(spark, ["a  b http://x c", None]), "t")
    assert [r.summary for r in df.collect()] == ["a b c", ""]
    assert _optimized(df).count("(?U)http") == 1


def test_classifier_reads_the_texts_once_and_sums_over_bounded_tasks(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows, *a: (seen.append((rows.columns, rows.rdd.getNumPartitions())), fit(self, rows, *a))[1])
    words = {"positive": "tăng mạnh", "negative": "giảm sâu", "neutral": "đi ngang"}
    rows = [(i, f"{words[k]} phiên {i % 5}", k, "train") for i, k in enumerate([*words] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, split string").repartition(40)
    model = training.train_classifier(df, include_stock_info=False)
    assert len(seen) == 3 and all(n <= spark.sparkContext.defaultParallelism and "text" not in c for c, n in seen)
    got = training.evaluate_classifier(model, df, include_stock_info=False)
    assert got.where("true_label = pred_label").count() == len(rows)


@pytest.fixture
def trend_tables(spark, tmp_path):
    at = lambda i: dt.datetime(2024, 1, 9, 6) + dt.timedelta(minutes=40 * i)
    events = [(i, at(i), i % 7, "view", 1.0, '{"k": %d}' % i) for i in range(40)]
    talks = [(c, t, "user" if t % 2 == 0 else "assistant", f"cổ phiếu tăng lần {t}") for c in range(3) for t in range(4)]
    for name, rows, schema in (("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
                               ("documents", [(i, "thị trường tăng mạnh", "vi", "a", 20) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long"),
                               ("conversations", talks, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["q_agg_token_bins_right_closed", "q_agg_token_bins"])
def test_token_bins_tokenise_the_sources_once(spark, monkeypatch, trend_tables, name):
    from tickpulse.plans import catalog_flows as cf

    seen, counts, bins = [], trending.window_counts, trending.token_bins
    monkeypatch.setattr(cf.tr, "window_counts", lambda toks, *a, **k: (seen.append(toks), counts(toks, *a, **k))[1])
    monkeypatch.setattr(cf.tr, "token_bins", lambda toks, *a, **k: (seen.append(toks), bins(toks, *a, **k))[1])
    rows = getattr(cf, name)(spark, trend_tables).collect()
    assert len(seen) == 2 and not any("documents.parquet" in f for toks in seen for f in toks.inputFiles())
    assert sum(r["count"] for r in rows if r.word == "tăng") > 0


def test_trending_job_joins_its_sources_once(spark, monkeypatch, trend_tables):
    from tickpulse.plans import catalog_flows as cf

    seen, daily, two = [], trending.trending_daily, trending.trending_2days
    monkeypatch.setattr(cf.tr, "trending_daily", lambda tu, *a, **k: (seen.append(tu), daily(tu, *a, **k))[1])
    monkeypatch.setattr(cf.tr, "trending_2days", lambda tu, *a, **k: (seen.append(tu), two(tu, *a, **k))[1])
    rows = cf.q_flow_trending_job(spark, trend_tables).collect()
    assert len(seen) == 2 and not any("documents.parquet" in f for tu in seen for f in tu.inputFiles())
    assert {r.analysis for r in rows} == {"daily", "2days"}
