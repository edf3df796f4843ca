import random
import re

import pytest
from pyspark.sql import functions as F

from tickpulse.llm.mixing import balance, mix, source_targets


def brute_targets(totals, weights=(1, 2, 3), most=3):
    """Fill up by weight, cut at the limit, share out the rest again until nothing is cut."""
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [s for s in totals if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(totals.values()))
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        cut = [s for s in open_ if target[s] + level * weight[s] >= most * totals[s] - 1e-9]
        if not cut:
            for s in open_:
                target[s] += level * weight[s]
            break
        for s in open_:
            target[s] += level * weight[s]
        left = sum(target[s] - most * totals[s] for s in cut)
        for s in cut:
            target[s] = most * totals[s]
        open_ -= set(cut)
    return target


def rows_of(seed, n=600):
    r = random.Random(seed)
    source = lambda: r.choice(["a", "a", "a", "a", "b", "B", "ü", None, "z"])
    return [(i, " ".join("w" * r.randint(1, 4) for _ in range(r.choice([0, 1, 5, 30, 200]))), source()) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_targets_are_met(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(0))
    got = {r.doc_id: r for r in mix(docs).collect()}
    totals, longest = {}, {}
    for i, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert got[i].size == n and got[i].taken <= 3 * n
        totals[s] = totals.get(s, 0) + n
        longest[s] = max(longest.get(s, 0), n)
    want = brute_targets(totals)
    for s in totals:
        mine = [got[i] for i, _, x in rows if x == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == totals[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= longest[s]
    again = {r.doc_id: r.taken for r in mix(docs.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_newton_meets_any_feasible_target(spark):
    sizes = spark.createDataFrame([("a", k % 7 + 1) for k in range(70)] + [("b", 5)] * 10 + [("c", 0)] * 4, "source string, size long")
    targets = source_targets(sizes).withColumn("target", F.when(F.col("source") == "a", 3.5).otherwise(F.lit(140.0)))
    got = {r.source: r for r in balance(sizes, targets).collect()}
    import math

    for s, want in (("a", 3.5), ("b", 140.0)):
        words = [r["size"] for r in sizes.collect() if r.source == s]
        assert abs(sum(n * math.exp(got[s].a + got[s].b * (n / got[s].mean - 1)) for n in words) / want - 1) < 1e-8


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, None), (None, "", "a")], schema)).collect()] == [0, 0]
    one = mix(spark.createDataFrame([(None, "x y", None), (None, "x y", None), (3, "z " * 50_000, None)], schema)).collect()
    assert sum(r.taken for r in one) == sum(r.size for r in one) == 50_004
