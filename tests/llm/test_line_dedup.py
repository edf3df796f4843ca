import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tickpulse.llm.line_dedup import dedup_units
from tickpulse.llm.queries import op3_line_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_words, sep):
    key = lambda r: (r[0] is None, r[0] or 0)
    first, out = {}, []
    for i, t in sorted(set(rows), key=key):
        for pos, unit in enumerate(re.split(sep, t or "")):
            w = tuple(re.findall(r"[^\x20\x09-\x0D]+", unit.translate(LOWER)))
            if len(w) >= min_words:
                first.setdefault(w, (i, pos))
    for i, t in rows:
        units = re.split(sep, t or "")
        gone = set()
        for pos, unit in enumerate(units):
            w = tuple(re.findall(r"[^\x20\x09-\x0D]+", unit.translate(LOWER)))
            if len(w) >= min_words and first[w] != (i, pos):
                gone.add(pos)
        kept = "\n".join(u for p, u in enumerate(units) if p not in gone) if gone else t or ""
        out.append((i, len(units), len(gone), sum(len(units[p].encode()) for p in gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def check(spark, rows, min_words=2):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("raw", F.lit("x")).repartition(3)
    got = dedup_units(docs, min_words=min_words)
    names = ["doc_id", "n_units", "n_removed", "removed_bytes", "kept_sha256", "kept"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == brute(rows, min_words, "\n")
    text = dict(rows)
    for r in got.collect():
        for s in r.spans or ():
            cut = (text[r.doc_id] or "").encode()[s.start : s.end].decode()
            stays = (text[s.first_id] or "").encode()[s.first_start :].decode().split("\n")[0]
            assert cut.translate(LOWER).split() == stays.translate(LOWER).split()


@pytest.mark.parametrize("seed", range(2))
def test_against_a_dictionary(spark, seed):
    r = random.Random(seed)
    lines = ["", " ", "one", "Zwei ä  ö", "zwei Ä ö", "zwei ä ö", "the quick\tfox", "THE quick fox", "x y z", "日本 語", "日本  語 "]
    check(spark, [(i, "\n".join(r.choice(lines) + (str(r.randint(0, 9)) if r.random() < 0.5 else "") for _ in range(r.randint(0, 8)))) for i in range(200)])


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, "\n\n"), (None, "a b c"), (5, "a b c"), (7, "p q\np q\n"), (7, "p q\np q\n"), (8, "l l " * 40_000), (9, "L l " * 40_000)])
    check(spark, [])


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a b\nc d\n\ne f g"), (2, "x\n\nA b\nc d")], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_units(docs, paragraphs=True, min_words=3).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 1 and got[2].kept.strip() == "x"


def test_registered_query_takes_short_paragraphs(spark, tmp_path):
    units = ["All rights reserved.", "}", "", "  ", "one two three four", "a line of five words\nand another"]
    rows = [(i, "\n\n".join([units[i % 6], f"only {i}", units[i % 4], "}"])) for i in range(12)] + [(20, "\n\nx\n\n\ny"), (21, "\nx\n\ny\n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_line_dedup(spark, str(tmp_path)).collect()
    names = ["doc_id", "n_units", "n_removed", "removed_bytes", "kept_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == [r[:5] for r in brute(rows, 1, r"(?<=\n)\n")]
    assert {r.doc_id: r.removed_spans for r in got}[7] == "0-2,15-16"


def test_lines_as_units(spark):
    lines = ["All rights reserved.", "}", "", "  ", "one two three four", "a line of five words"]
    check(spark, [(i, "\n".join([lines[i % 6], f"only {i}", lines[i % 4], "}"])) for i in range(12)], min_words=1)
