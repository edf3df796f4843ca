import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickpulse.llm.periodic_runs import periodic_runs, word_runs


def brute_runs(w, least=6, times=4):
    """Every maximal stretch with its smallest period, by the definition."""
    n, spans = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                spans.setdefault((i, j + q), q)  # periods rise: the first one is the smallest
            i = j + 1
    return sorted((i, e - i, q) for (i, e), q in spans.items() if e - i >= max(least, times * q))


def brute(doc_id, text, planted):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, n, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(left), runs, left)


def check(spark, rows, planted=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x")).repartition(3)
    got = [(*r[:9], [tuple(x) for x in r[9]], r[10]) for r in periodic_runs(docs, planted=planted).collect()]
    assert sorted(got, key=str) == sorted((brute(d, t, planted) for d, t in rows), key=str)


@pytest.mark.parametrize("seed", range(40))
def test_word_runs_by_definition(seed):
    """Many short documents over tiny vocabularies in one call: runs nest, overlap and touch document ends."""
    r = random.Random(seed)
    docs = []
    for _ in range(r.randint(1, 30)):
        kind, k = r.randrange(3), r.randint(1, 3)
        if kind == 0:
            docs.append([r.randrange(k) for _ in range(r.randint(0, 40))])
        elif kind == 1:
            unit = [r.randrange(3) for _ in range(r.randint(1, 6))]
            docs.append([r.randrange(3) for _ in range(r.randint(0, 5))] + unit * r.randint(1, 12) + unit[: r.randint(0, len(unit))] + [r.randrange(3) for _ in range(r.randint(0, 5))])
        else:  # repetitions of repetitions
            unit = [0] * r.randint(1, 5) + [1]
            docs.append((unit * r.randint(1, 5) + [2]) * r.randint(1, 6))
    docs = [x for x in docs if x]
    if not docs:
        return
    count = np.array([len(x) for x in docs])
    head = np.cumsum(count) - count
    start, length, period = word_runs(np.concatenate(docs), np.repeat(np.arange(len(docs)), count), np.repeat(head, count), np.repeat(head + count, count), 2, 2)
    got = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    assert got == [(s + h, n, q) for h, x in zip(head.tolist(), docs, strict=True) for s, n, q in brute_runs(x, 2, 2)]


def test_rows(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, f"start{i} " + "tick tock " * i + "end") for i in range(12)]
    rows += [(None, "x " * 30), (None, None), (7, "x " * 30), (7, "x " * 30), (200, ""), (201, " \n\t"), (202, "one"), (203, "A a A a A a A a A a"), (204, "é " * 9 + "  " * 9)]
    rows += [(300, "long " * 20000), (301, " ".join(f"w{i}" for i in range(5000)) + " w4999" * 7)]
    check(spark, rows[:-2] + [(301, "q " * 300)])
    check(spark, rows[:-2], planted=True)
    (a, b) = periodic_runs(spark.createDataFrame(rows[-2:], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (a["n_runs"], a["start"], a["length"], a["period"], a["exponent_milli"], a["collapsed"]) == (1, 0, 20000, 1, 20000000, "long")
    assert (b["n_runs"], b["start"], b["length"], b["period"]) == (1, 4999, 8, 1)


def test_planted_documents_of_the_table(spark):
    """The registered query's parameters on whole documents of the shared table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: tuple(r) for r in periodic_runs(docs, planted=True, with_text=False).collect()}
    rows = [x for x in docs.select("doc_id", "text").collect() if len(x["text"]) < 6000]
    assert len(rows) > 150
    for d, t in rows:
        assert got[d] == brute(d, t, True)[:9]


def test_an_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
