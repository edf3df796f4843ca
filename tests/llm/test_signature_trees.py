import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickpulse.llm import signature_trees as mod
from tickpulse.llm.files import RecordReader, RecordWriter
from tickpulse.llm.scratch import shared_dir
from tickpulse.llm.signature_trees import jaccard_join

from .test_minhash_join import brute, corpus


def check(spark, rows, words=5, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("family", F.lit("x")).repartition(3)
    got = sorted(map(tuple, jaccard_join(docs, words=words, **kw).collect()), key=str)
    assert got == sorted((r[:3] for r in brute(rows, words, kw.get("percent", 80))), key=str)


def half_alike(seed, n):
    """Many texts over a few sources that share half of their words or more, many of them near the threshold."""
    r = random.Random(seed)
    base = [[f"b{k}_{i}" for i in range(80)] for k in range(3)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 2, 3, 4, 12])):
            w[r.randrange(80)] = f"x{r.randrange(3000)}"
        if r.random() < 0.3:
            w[r.randrange(40) :] = [f"y{r.randrange(10**6)}" for _ in range(40)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "words"), [(0, 2), (1, 5)])
def test_against_all_pairs(spark, seed, words):
    check(spark, corpus(seed, 200), words)


def test_large_families_go_through_the_trees(spark, monkeypatch):
    """Leaves of four sets: families of hundreds need several levels and the dual traversal."""
    monkeypatch.setattr(mod, "_LEAF_SETS", 4)
    steps = []
    real = mod._descend
    monkeypatch.setattr(mod, "_descend", lambda *a: steps.append(1) or real(*a))
    check(spark, half_alike(4, 300), 5)
    assert len(steps) >= 2


def test_the_other_percent(spark):
    check(spark, half_alike(6, 80), 2, percent=60)


def test_odd_rows(spark):
    long = " ".join(f"l{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "b a"), (None, "a b"), (None, "only here"), (8, long), (9, long + " end"), (10, "a b"), (10, "a b"), (11, "x"), (11, "y"), (12, "a b c d e f g h"), (None, "a b c d e f g h i")]
    check(spark, rows)
    check(spark, [])


def test_a_node_never_rules_out_a_link():
    """The bound of two nodes is at least the overlap of any of their sets, whatever the collisions."""
    r = np.random.default_rng(3)
    for _ in range(50):
        sets = [np.unique(r.integers(0, 400, r.integers(1, 300)).astype(np.uint64)) for _ in range(6)]
        maps = [mod._bitmap(s, 256) for s in sets]
        excess = [len(s) - int(np.bitwise_count(m).sum()) for s, m in zip(sets, maps)]
        x, y = (np.bitwise_or.reduce(maps[a:b]) for a, b in ((0, 3), (3, 6)))
        most = int(np.bitwise_count(x & y).sum()) + min(max(excess[:3]), max(excess[3:]))
        both = mod._overlaps(sets)
        assert most >= both[:3, 3:].max()
        assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(6) for j in range(6))


def test_pairs_of_nodes_carry_neither_sets_nor_bitmaps(spark, monkeypatch):
    """What meets a pair's two sides are places of records: sets and bitmaps are written once, not once per pair."""
    monkeypatch.setattr(mod, "_LEAF_SETS", 4)
    plans, real = {}, mod.written

    def look(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(mod, "written", look)
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    check(spark, half_alike(4, 150), 5)
    assert plans["tree-links"] and len(plans["node-pairs"]) >= 2
    assert not [p for n in ("node-pairs", "tree-links") for p in plans[n] if "tokens" in p or "bits" in p]
    assert not [f for f in set(os.listdir(shared)) - before if "records" in f]


def test_links_across_two_leaves():
    r = np.random.default_rng(5)
    for _ in range(30):
        base = np.unique(r.integers(0, 1 << 40, 60).astype(np.uint64))
        sets = [np.unique(np.append(r.choice(base, len(base) - r.integers(0, 9), replace=False), r.integers(0, 1 << 40, r.integers(0, 9)).astype(np.uint64))) for _ in range(7)]

        def record(part):
            flat, size = np.concatenate(part), np.array([len(s) for s in part])
            order = np.argsort(flat, kind="stable")
            return None, size, flat[order], np.repeat(np.arange(len(part)), size)[order].astype(np.uint32)

        cross = mod._links(sets, 80)
        cross[:3, :3] = cross[3:, 3:] = False
        assert mod._cross_links(record(sets[:3]), record(sets[3:]), 80) == mod._forest(cross)


def test_records_are_found_again(tmp_path):
    folder = f"file://{tmp_path}/records"
    writers = [RecordWriter(folder) for _ in range(3)]
    places = [(w.add((i, b"x" * i)), (i, b"x" * i)) for i in range(200) for w in writers[:2]]
    for w in writers:
        w.close()
    assert len(os.listdir(tmp_path / "records")) == 2
    records = RecordReader(folder)
    assert all(records.get(*place) == record for place, record in places[::-1] + places)
    records.close()
