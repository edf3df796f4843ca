import hashlib
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from tickpulse.llm.exact_dedup import build_filter, exact_dedup, filter_has

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out, seen = [], set()
    for i, t in rows:
        n = (t or "").translate(LOWER)
        ids = [x for x in groups[n] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[n]), i == keep and (i, n) not in seen, hashlib.sha256(n.encode()).hexdigest()))
        seen.add((i, n))
    return sorted(out, key=str)


def check(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sha", F.lit(1)).withColumn("old", F.lit("x")).repartition(3)
    assert sorted(map(tuple, exact_dedup(docs, **kw).collect()), key=str) == brute(rows)


def test_against_grouping(spark):
    rows = [(i, "Text %d" % (i % 37) if i % 3 else "TEXT %d" % (i % 11)) for i in range(300)]
    check(spark, rows)
    check(spark, rows, in_snapshot=F.col("doc_id") < 250)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, ""), (None, "only null ids"), (3, "ÄB"), (4, "äB"), (5, "äb"), (6, "x" * 100_000), (7, "X" * 100_000), (8, "r"), (8, "R"), (8, "r")]
    check(spark, rows)
    check(spark, [])


def test_filter_has_all_its_keys_and_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 200_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        f = build_filter(keys)
        assert filter_has(keys, *f).all()
        others = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
        if n > 10:
            assert filter_has(others, *f).mean() < 0.01
            assert len(f[3]) < 3 * n + 1000
