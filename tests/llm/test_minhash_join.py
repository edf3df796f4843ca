import inspect
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tickpulse.llm import minhash_join
from tickpulse.llm.minhash_join import keep_one, near_duplicates

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < words else [tuple(w[i : i + words]) for i in range(len(w) - words + 1)])


def brute(rows, words, percent=80):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(s), low.get(root(i)), d is not None and d == low.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def check(spark, rows, words=2, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("sig", F.lit("x")).repartition(3)
    assert sorted(map(tuple, near_duplicates(docs, words=words, **kw).collect()), key=str) == brute(rows, words)


def corpus(seed, n, vocab=40, edits=3):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(vocab)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = (rows[r.randrange(len(rows))][1] or "").split()
            for _ in range(r.randint(0, edits)):
                if w:
                    w[r.randrange(len(w))] = r.choice(voc)
        else:
            w = [r.choice(voc) for _ in range(r.choice([1, 2, 3, 8, 40, 80]))]
        rows.append((i, " ".join(w) if i % 5 else " ".join(w).upper()))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    check(spark, corpus(seed, 150))


def test_one_large_group_and_a_common_passage(spark):
    """Most rows are variants of one text near the threshold, at production parameters."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:20]) + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(6))) for i in range(60)]
    check(spark, rows)


def test_some_hundred_half_alike_texts(spark):
    """Texts that share half of their words in blocks: the lists they meet in are settled exactly."""
    r = random.Random(8)
    blocks = [[f"k{b}_{i}" for i in range(12)] for b in range(10)]
    rows = []
    for i in range(350):
        w = [x for b in sorted(r.sample(range(10), 5)) for x in blocks[b]] + [f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 20))]
        if r.random() < 0.3:
            w[r.randrange(len(w))] = f"v{i}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_kept_rows_keep_odd_columns(spark):
    """Names that the operator uses itself, and maps inside other columns."""
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (3, "x y", 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v long")
    docs = docs.select("*", F.col("v").alias("__id"), F.col("v").alias("__raw"), F.col("v").alias("___none"), F.array(F.struct(F.create_map(F.lit("k"), "v").alias("m"))).alias("node"))
    got = sorted((r.doc_id, r["__id"], r["node"][0]["m"]["k"]) for r in keep_one(docs).where("doc_id is not null").collect())
    assert got == [(1, 1, 1), (3, 3, 3)]
    assert keep_one(docs).columns == docs.columns


def test_odd_rows(spark):
    long = " ".join(f"l{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "b a"), (None, "a b"), (None, "only here"), (8, long), (9, long + " end"), (10, "a b"), (10, "a b"), (11, "x"), (11, "y"), (12, "ÄB c"), (13, "äb c"), (14, "a b c")]
    check(spark, rows)
    check(spark, rows, words=5)
    check(spark, [])


def test_a_link_at_the_threshold_is_missed_no_more_often_than_with_14_of_32():
    miss = lambda n, need: sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(need))
    for f in (near_duplicates, keep_one):
        given = inspect.signature(f).parameters
        assert miss(given["coords"].default, given["need"].default) <= miss(32, 14)


def near_threshold(n):
    """Texts over one source with a tenth of their words changed: most agree with a centre, few are linked with it."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(120), r.choice([5, 6, 7])):
            w[at] = f"x{r.randrange(60)}"
        rows.append((i, " ".join(w)))
    return rows


def test_short_lists_need_no_trees(spark, monkeypatch):
    """All pairs of a list of 64 or less are looked at where the list is read; only longer lists are left open."""
    asked = []
    real = minhash_join._settled
    monkeypatch.setattr(minhash_join, "_settled", lambda *a: asked.append(1) or real(*a))
    check(spark, near_threshold(40))
    assert not asked
    monkeypatch.setattr(minhash_join, "_SHORT", 8)
    check(spark, near_threshold(40))
    assert asked
