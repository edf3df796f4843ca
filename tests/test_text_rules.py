"""Literal-row fixtures for the text rules (FIXTURES section 4)."""

import math

from pyspark.sql import functions as F

from conftest import one_col
from tickpulse.constants import RUMOR_PATTERNS
from tickpulse.functions import sentences as fs
from tickpulse.functions import text as ft
from tickpulse.functions import tickers as tk
from tickpulse.functions.rumor_rules import accept_rewrite, rewrite_text, rumor_pattern
from tickpulse.functions.timewin import normalize_calendar_date

BOUNDARY = "VNĐ FPT mua, SSI#x  a_FPT Đặng HPG."


def test_candidates_respect_unicode_boundaries(spark):
    df = one_col(spark, [BOUNDARY])
    got = df.select(tk.candidates(F.col("t")).alias("c")).first().c
    assert got == ["FPT", "MUA", "SSI", "HPG"]


def test_tokenizer_row(spark):
    df = one_col(spark, [BOUNDARY])
    got = df.select(ft.tokenize(F.col("t"), stopwords=[]).alias("c")).first().c
    # before the length filter the tokens are vnđ fpt mua ssi x a fpt đặng hpg
    assert got == ["vnđ", "fpt", "mua", "ssi", "fpt", "đặng", "hpg"]


def test_tokenizer_drops_links_digits_and_stopwords(spark):
    df = one_col(spark, ["Xem http://a.b/c www.x.vn là 2024 giá 12a và"])
    got = df.select(ft.tokenize(F.col("t")).alias("c")).first().c
    assert got == ["xem", "giá", "12a"]


def test_rumor_patterns(spark):
    df = one_col(spark, ["Nghe đồn FPT sắp chia cổ tức", "Reportedly HPG up", "FPT tăng mạnh", None])
    got = [r.p for r in df.select(rumor_pattern("t").alias("p")).collect()]
    assert got[0] == RUMOR_PATTERNS[0]
    assert got[1] == r"\breportedly\b"
    assert got[2] is None and got[3] is None


def test_rewrite_opinion_cue(spark):
    df = one_col(spark, ["hình như HPG tăng", "nghe đồn FPT sắp chia cổ tức", "FPT tăng mạnh"])
    got = [r.r for r in df.select(accept_rewrite(rewrite_text(F.col("t")), F.col("t")).alias("r")).collect()]
    assert got[0] == "Theo nhận định, HPG tăng"
    assert got[1] == "Theo thông tin đồn đoán, FPT sắp chia cổ tức"
    assert got[2] == "FPT tăng mạnh"  # no cue: the rule rewriter gives nothing, the original is kept


def test_validate_symbol(spark):
    df = one_col(spark, [" fpt-vn@hose ", "", None, "@@"])
    got = [r.s for r in df.select(ft.validate_symbol("t").alias("s")).collect()]
    assert got == ["FPTVNHOSE", None, None, None]  # cleaned, never cut


def test_normalize_date(spark):
    rows = [("Sun\nOct 5", "2025-10-04"), ("Thu Jan 1", "2025-12-30"), ("x", "2025-10-04"), ("  ", "2025-10-04")]
    out = []
    for raw, base in rows:
        df = one_col(spark, [raw])
        out.append(df.select(normalize_calendar_date(F.col("t"), base).alias("d")).first().d)
    assert out == ["2025-10-05", "2026-01-01", "x", ""]


def test_text_present(spark):
    df = one_col(spark, [None, "", "NA", "ok"])
    assert [r.t for r in df.where(ft.text_present("t")).collect()] == ["ok"]


def test_capital_split(spark):
    df = one_col(spark, ["Hôm nay FPT tăng Mai xem"])
    assert df.select(fs.split_by_capital("t").alias("s")).first().s == ["Hôm nay FPT tăng", "Mai xem"]


def test_common_word_ticker_needs_upper_case_and_clean_context(spark):
    d = tk.TickerDictionary(["FPT", "IT"])
    df = one_col(spark, ["IT FPT tăng mạnh", "ngành it FPT tăng", "margin IT FPT lên", "IT"])
    got = [r.c for r in df.select(tk.rule_codes(F.col("t"), d).alias("c")).collect()]
    assert got == [["FPT", "IT"], ["FPT"], ["FPT"], []]


def test_important_sentence_prefers_scored_sentence(spark):
    text = ("FPT mở cửa. Thị trường hôm nay giao dịch sôi động và cổ phiếu FPT tăng 5 phần trăm. "
            "Cuối ngày FPT đóng cửa.")
    df = one_col(spark, [text])
    got = df.select(fs.important_sentences(fs.split_sentences("t"), F.array(F.lit("FPT"))).alias("m")).first().m
    assert got[0].sentence == text.strip()  # the middle sentence wins; context = prev + it + next


def test_growth_and_score_arithmetic(spark):
    from tickpulse.operators.trending import growth, trend_score

    df = spark.createDataFrame([(5, 0), (427, 4083)], "count_today long, count_prev long")
    rows = df.withColumn("growth", growth()).withColumn("score", trend_score()).collect()
    assert rows[0].growth == 5.0 and math.isclose(rows[0].score, math.sqrt(5) * 6)
    # golden sample output: 'mua' 427 with growth -0.8952007835455436 and score 2.1655687367439627
    assert math.isclose(rows[1].growth, -0.8952007835455436, rel_tol=1e-12)
    assert math.isclose(rows[1].score, 2.1655687367439627, rel_tol=1e-9)
