import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickpulse.llm.quality import FactorisationMachine, features, keep_good, score, train

SF = "/root/testdata/sf0.01"


def test_pair_sum_equals_all_pairs():
    rng = np.random.default_rng(0)
    buckets, rank = 32, 3
    texts = pa.array(["a b c a", None, "", "Long line!\nsecond 12 line", "x"])
    m = FactorisationMachine(buckets, np.zeros(18), np.ones(18), 0.3, rng.normal(size=50), rng.normal(size=(50, rank)) / 5)
    for _, s, starts, bucket, weight in features(texts, buckets):
        got = m.score(s, starts, bucket, weight)
        for i in range(len(texts)):
            x = [(int(b), w) for b, w in zip(bucket[starts[i] : starts[i + 1]], weight[starts[i] : starts[i + 1]])]
            x += [(buckets + j, v) for j, v in enumerate(np.clip(s[i], -6, 6))]
            margin = m.bias + sum(m.linear[j] * v for j, v in x) + sum(m.factors[a] @ m.factors[b] * v * w for (a, v), (b, w) in combinations(x, 2))
            assert abs(got[i] - 1 / (1 + np.exp(-margin))) < 1e-9


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = score(docs, train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    right = (got.predicted == got.quality).mean()
    assert right >= 0.93 and (got[got.quality == 0].predicted == 0).mean() >= 0.6 and (got[got.quality == 1].predicted == 1).mean() >= 0.97


def test_only_the_text_counts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    model = train(docs, labels, sample=100)
    a = {r.doc_id: r.score for r in score(docs, model).collect()}
    b = {r.doc_id - 7: r.score for r in score(docs.withColumn("doc_id", F.col("doc_id") + 7).withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), model).collect()}
    assert a == b
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in score(docs, model).collect())
    again = train(docs.repartition(5), labels, sample=100)
    assert np.allclose(model.factors, again.factors) and model.bias == again.bias


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "x " * 100_000), (4, "日本 ß\n\n!"), (4, "日本 ß\n\n!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("label", F.lit(3))
    none = spark.createDataFrame([], "doc_id long, quality int")
    blank = train(docs, none)
    assert {r.score for r in score(docs, blank).collect()} == {0.5}
    one = train(docs, spark.createDataFrame([(1, 1), (None, 0), (2, None), (4, 1), (4, 0), (99, 0)], "doc_id long, quality int"))
    got = score(docs, one).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert keep_good(docs, blank).columns == docs.columns and keep_good(docs, blank).count() == 6
    assert score(docs.limit(0), one).count() == 0
