"""ROUGE scores for rewrite evaluation (fn_rouge_1/2/L, agg_rouge_mean).

Tokens follow the common ROUGE tokenizer: lower case, runs of [a-z0-9]
(no stemming -- a declared rule).  ROUGE-N is computed relationally: n-gram
counts of both sides per (pair, gram), overlap = sum of minima.  The
shuffle is keyed by (pair, gram), so a long text spreads over many tasks.
ROUGE-L needs the longest common subsequence per pair; it runs as an Arrow-batched
pandas UDF that keeps one row of the table in the bits of an integer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rouge_tokens(col):
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), 0)


def _grams(side: str, n: int):
    toks = rouge_tokens(F.col(side))
    if n == 1:
        return toks
    grams = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))


def _overlaps(pairs: DataFrame, ns: tuple[int, ...]) -> DataFrame:
    """``id, n, overlap, ref_total, pred_total`` for every pair and n, from one pass over the pairs: the grams of both
    sides are exploded together, counted per (pair, n, gram) and summed per (pair, n)."""
    def marked(side, n, r):
        return F.transform(_grams(side, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(r).alias("r")))

    sides = [marked(side, n, r) for n in ns for side, r in (("reference", 1), ("prediction", 0))]
    marks = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(None).cast("string").alias("g"), F.lit(0).alias("r")) for n in ns])
    flat = pairs.select("id", F.explode(F.concat(marks, *sides)).alias("x")).select("id", "x.*")  # a mark keeps pairs without grams
    real = F.col("g").isNotNull()
    per = flat.groupBy("id", "n", "g").agg(F.count(F.when(real & (F.col("r") == 1), 1)).alias("a"), F.count(F.when(real & (F.col("r") == 0), 1)).alias("b"))
    return per.groupBy("id", "n").agg(F.sum(F.least("a", "b")).alias("overlap"), F.sum("a").alias("ref_total"), F.sum("b").alias("pred_total"))


def _prf(df: DataFrame) -> DataFrame:
    p = F.when(F.col("pred_total") > 0, F.col("overlap") / F.col("pred_total")).otherwise(F.lit(0.0))
    r = F.when(F.col("ref_total") > 0, F.col("overlap") / F.col("ref_total")).otherwise(F.lit(0.0))
    df = df.withColumn("precision", p).withColumn("recall", r)
    f = F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return df.withColumn("fmeasure", f).select("id", "precision", "recall", "fmeasure")


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """(id, precision, recall, fmeasure) of n-gram overlap between ``prediction`` and ``reference``."""
    return _prf(_overlaps(pairs, (n,)))


def _lcs(a, b) -> int:
    """Length of the longest common subsequence, one row of the table per big-integer step."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full  # zero bits mark the rows where the length grows
    for y in b:
        hit = open_ & where.get(y, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs_udf(ref: pd.Series, pred: pd.Series) -> pd.Series:
    return pd.Series([_lcs(list(a), list(b)) for a, b in zip(ref, pred)], dtype="int32")


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(id, precision, recall, fmeasure) from the longest common token subsequence."""
    d = pairs.select("id", rouge_tokens(F.col("reference")).alias("rt"), rouge_tokens(F.col("prediction")).alias("pt"))
    d = d.select("id", _lcs_udf("rt", "pt").alias("overlap"), F.size("rt").alias("ref_total"),
                 F.size("pt").alias("pred_total"))
    return _prf(d)


def rouge_means(pairs: DataFrame) -> DataFrame:
    """agg_rouge_mean: mean F of ROUGE-1, ROUGE-2 and ROUGE-L over all pairs."""
    f1 = _overlaps(pairs, (1, 2))
    both = _prf(f1.withColumn("id", F.struct("id", "n"))).groupBy(F.col("id.n").alias("n")).agg(F.avg("fmeasure").alias("f"), F.count(F.lit(1)).alias("pairs"))
    last = rouge_l(pairs).agg(F.lit(0).alias("n"), F.avg("fmeasure").alias("f"), F.count(F.lit(1)).alias("pairs"))
    every = both.unionByName(last)  # three rows
    pick = lambda n: F.max(F.when(F.col("n") == n, F.col("f")))
    return every.agg(pick(1).alias("rouge1"), pick(2).alias("rouge2"), pick(0).alias("rougeL"), F.max("pairs").alias("pairs"))
