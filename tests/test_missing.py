"""Lag over all dates, quantiles by rank refinement, line numbers, partitioned outputs, the dictionary as a table."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickpulse.functions.tickers import TickerDictionary, rule_codes
from tickpulse.operators import joins, training, trending
from tickpulse.session import scratch_path
from tickpulse.sources import unified


def test_the_lag_follows_present_dates(spark):
    r = random.Random(2)
    days = sorted(r.sample(range(60), 15))  # with gaps
    count = {(d, w): r.randint(1, 9) for d in days for w in "abcde" if r.random() < 0.6}
    base = dt.date(2024, 1, 1)
    rows = [(base + dt.timedelta(days=d), w, n) for (d, w), n in count.items()]
    present = sorted({d for d, _ in count})
    want = {}
    for before, d in zip([None, *present], present):
        for w in "abcde":
            now, prev = count.get((d, w), 0), count.get((before, w), 0)
            if now or prev:
                want[base + dt.timedelta(days=d), w] = (now, prev)
    got = trending.prev_day_lag(spark.createDataFrame(rows, "date date, word string, count long")).collect()
    assert {(x.date, x.word): (x.count_today, x.count_prev) for x in got} == want


def test_the_latest_dates_with_a_token(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [(day(1), "cổ phiếu"), (day(3), "tăng mạnh"), (day(5), "123 456"), (day(7), ""), (day(9), None), (day(11), "http://a.b/c"), (day(13), "x")]
    texts = spark.createDataFrame(rows, "date date, text string")
    counts, found = trending.latest_token_counts(texts)
    assert found == [day(3), day(1)] and {r.date for r in counts.collect()} == {day(3), day(1)}
    assert trending.latest_token_counts(texts.where("text = 'x'"))[1] == []
    empty = texts.where("false").withColumnRenamed("text", "content")
    assert trending.trending_daily(empty, zone=None).count() == 0


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    groups = {"ties": r.integers(0, 4, 900) / 4, "wide": np.exp(r.normal(0, 9, 300)), "one": np.array([3.5]), "two": np.array([-1.0, 2.0]), None: r.normal(size=333), "ends": np.array([-np.inf, 1.0, 2.0, 7.0, np.inf, 1.5])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("one", None), ("one", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(x.g, x.q): x.value for x in training.exact_quantiles(df, "g", "x", qs, slots=64).collect()}
    assert set(got) == {(g, q) for g in groups for q in qs}
    for g, v in groups.items():
        for q in qs:
            v = np.sort(v)
            at = q * (len(v) - 1)
            a, b = v[int(np.floor(at))], v[int(np.ceil(at))]
            want = a if a == b else a + (b - a) * (at - np.floor(at))
            assert got[g, q] == pytest.approx(want, rel=1e-12) or got[g, q] == want


def test_describe_buffers_no_values(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("true_label"), (F.col("id") / 7).alias("confidence"))
    out = training.confidence_describe(df)
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    row = {r.true_label: r for r in out.collect()}["1"]
    x = np.arange(1, 3000, 3) / 7
    assert (row["count"], row["min"], row["max"]) == (1000, x[0], x[-1])
    assert [row.p25, row.p50, row.p75] == pytest.approx(np.percentile(x, [25, 50, 75]))


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_numbers_are_those_of_cat(spark, small_splits, tmp_path):
    r = random.Random(4)
    lines = []
    for name in ("a.txt", "b.txt", "c.txt"):
        mine = [f"{name} {r.randrange(10**6)} " + "x" * r.randrange(90) if r.random() < 0.9 else "" for _ in range(120)]
        (tmp_path / name).write_text("\n".join(mine) + ("\n" if name != "b.txt" else ""))
        lines += mine
    got = unified.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert [(x.line_no, x.value) for x in got] == list(enumerate(lines))


def test_the_ordered_split_follows_the_lines(spark, small_splits, tmp_path):
    r = random.Random(5)
    texts = [f"{r.randrange(10**9)}" for _ in range(200)]  # no order in the content
    rows = [f'{{"original": "o{t}", "rewriter": "w{t}"}}' if i % 7 else "not json" for i, t in enumerate(texts)]
    (tmp_path / "p1.jsonl").write_text("\n".join(rows[:90]) + "\n")
    (tmp_path / "p2.jsonl").write_text("\n".join(rows[90:]) + "\n")
    want = [f"o{t}" for i, t in enumerate(texts) if i % 7]
    got = training.ordered_split(unified.read_pairs_jsonl(spark, str(tmp_path), numbered=True)).orderBy("line_no").collect()
    assert [x.original for x in got] == want
    assert [x.split for x in got] == ["train"] * int(len(want) * 0.9) + ["test"] * (len(want) - int(len(want) * 0.9))


def test_a_part_without_rows_is_left_untouched(spark):
    path = scratch_path(spark, "parts")
    schema = "text string, has_stock boolean, confidence double"
    training.write_by_stock(spark.createDataFrame([("a", True, 0.9), ("b", False, 0.9), ("c", True, 0.1)], schema), path, min_confidence=0.5)
    training.write_by_stock(spark.createDataFrame([("new", True, 0.9)], schema), path)
    back = spark.read.parquet(path)
    assert sorted((r.text, r.part) for r in back.collect()) == [("b", "without_stock"), ("new", "with_stock")]
    plan = back.where("part = 'with_stock'")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "with_stock" in filters


def test_the_dictionary_table_equals_the_inlined_one(spark):
    names = [a + b + c + d for a in "BCDFGHJKLMNPQRS" for b in "ABCDEFGHIJKLMNOP" for c in "ABCDEFGHIJKLMNOP" for d in "ABCDEFGHIJKLMNOP"][:60_000]
    r = random.Random(6)
    texts = [" ".join(r.choice(["mua", r.choice(names), "IT", "it", "AI", "ib IT", "IT margin", "x" * 30, "FPT", "a_FPT", "ZZZZ"]) for _ in range(r.randint(0, 25))) for _ in range(120)]
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, "FPT")], "id long, t string")
    symbols = [*names[:5000], "IT", "AI", "FPT", "M&A", "LONGER"]
    want = {x.id: x.c for x in df.select("id", rule_codes(F.col("t"), TickerDictionary(sorted(symbols))).alias("c")).collect()}
    table = spark.createDataFrame([(f" {s.lower()} ",) for s in symbols + names[:9]] + [(None,), ("",)], "symbol string")
    got = joins.codes_by_table(df, "id", "t", table)
    assert {x.id: x.codes for x in got.collect()} == {k: v or [] for k, v in want.items()}
    # all 60,000 as well, without a literal list in the plan
    big = joins.codes_by_table(df, "id", "t", spark.createDataFrame([(s,) for s in names], "symbol string"))
    assert names[-1] not in big._jdf.queryExecution().analyzed().toString()
    assert sum(len(x.codes) for x in big.collect()) >= sum(len(v or []) for v in want.values()) // 4


def test_a_model_is_loaded_once_per_worker_and_bad_texts_stay_apart(spark, tmp_path):
    import pandas as pd

    from tickpulse.operators.sentiment import LoadedScorer, transform_sentiment

    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")

        def score(s):
            if s.str.contains("boom").any():
                raise ValueError("boom")
            return pd.DataFrame({"label": ["positive"] * len(s), "score": [0.75] * len(s)})

        return score

    df = spark.createDataFrame([(i, "boom text" if i == 7 else f"good text {i}") for i in range(40)], "id long, t string").repartition(12)
    got = {r.id: (r.sentiment, r.confidence, r.sentiment_source) for r in transform_sentiment(df, "t", LoadedScorer(load, "m@1")).collect()}
    assert got.pop(7) == ("TRUNG_TÍNH", 0.5, "Scorer failed")
    assert set(got.values()) == {("TÍCH_CỰC", 0.75, "loaded_model")}
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) < 12


def test_a_pipeline_scores_the_cleaned_text(spark):
    from tickpulse.operators.sentiment import saved_scorer, transform_sentiment

    rows = [(i, f"{'good' if i % 2 else 'bad'} words {i}", "positive" if i % 2 else "negative", "train") for i in range(60)]
    model = training.train_classifier(spark.createDataFrame(rows, "doc_id long, text string, label string, split string"), include_stock_info=False)
    path = scratch_path(spark, "model")
    model.write().save(path)
    texts = spark.createDataFrame([(1, "bad http://good.good/good bad", "kept"), (2, "good", "kept")], "id long, text string, model_text string")
    got = {r.id: r for r in transform_sentiment(texts, "text", saved_scorer(path, ["negative", "neutral", "positive"], "model_text")).collect()}
    assert (got[1].sentiment, got[2].sentiment, got[1].model_text) == ("TIÊU_CỰC", "TÍCH_CỰC", "kept")


def test_whole_words_only(spark):
    from tickpulse.plans import flows

    posts = spark.createDataFrame([("p", "Hôm nay FPT tăng. Còn FPTS thì giảm", dt.datetime(2024, 1, 1))], "post_id string, post_content string, post_at timestamp_ntz")
    assert flows.yt_mentions(posts, ["FPT"]).count() == 2
    assert [r.post_sentence for r in flows.yt_mentions(posts, ["FPT"], whole_word=True).collect()] == ["Hôm nay FPT tăng."]


def test_untagged_posts_can_be_kept(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("1", "a", day, '[{"symbol":"FPT"}]'), ("2", "b", day, "[]"), ("3", "c", day, None)]
    posts = spark.createDataFrame(rows, "post_id string, original_content string, date timestamp_ntz, tagged_symbols string")
    span = (day, day + dt.timedelta(days=1))
    assert [r.id for r in unified.fireant_tagged(posts, *span).collect()] == ["1"]
    assert sorted((r.id, r.symbols) for r in unified.fireant_tagged(posts, *span, keep_untagged=True).collect()) == [("1", "FPT"), ("2", None), ("3", None)]


def test_a_shorter_list_replaces_its_interval(spark):
    from tickpulse.operators.upsert import upsert_ranks

    schema = "interval string, row_num int, symbol string"
    old = spark.createDataFrame([("24h", 1, "a"), ("24h", 2, "b"), ("week", 1, "c")], schema)
    new = spark.createDataFrame([("24h", 1, "z")], schema)
    rows = lambda **kw: sorted(map(tuple, upsert_ranks(old, new, ["interval", "row_num"], **kw).collect()))
    assert rows() == [("24h", 1, "z"), ("24h", 2, "b"), ("week", 1, "c")]
    assert rows(replace_interval=True) == [("24h", 1, "z"), ("week", 1, "c")]


def test_texts_at_the_midnight_of_their_day(spark):
    base = dt.datetime(2024, 1, 10)
    rows = [(base + dt.timedelta(hours=h), "vàng") for h in (-30, -20, -2, 2, 11)]
    texts = spark.createDataFrame(rows, "date timestamp_ntz, content string")
    run = lambda **kw: {(r.count_today, r.count_prev) for r in trending.trending_2days(texts, base + dt.timedelta(hours=12), zone=None, **kw).collect()}
    assert run() == {(3, 2)}
    assert run(truncate_to_day=True) == {(2, 2)}
