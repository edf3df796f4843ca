import hashlib
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402

from tests.llm.test_minhash_join import brute as near_brute  # noqa: E402
from tests.llm.test_mixing import brute_targets  # noqa: E402
from tickpulse.llm.exact_dedup import keep_last  # noqa: E402
from tickpulse.llm.minhash_join import keep_one  # noqa: E402
from tickpulse.llm.mixing import take_mix  # noqa: E402
from tickpulse.llm.quality import score, train  # noqa: E402
from tickpulse.llm.scratch import written  # noqa: E402

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay_those_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_stage_keeps_what_the_score_says(spark, stages):
    docs = stages[0]
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in score(docs, model).collect() if r.score >= 0.3}
    assert set(rows(stages[1])) == want and rows(stages[1]).items() <= rows(docs).items()


def test_exact_stage_keeps_the_last_of_equal_texts(stages):
    last = {}
    for i, r in rows(stages[1]).items():
        t = (r.text or "").translate(LOWER)
        last[t] = max(i, last.get(t, i))
    assert set(rows(stages[2])) == set(last.values()) and stages[2].count() == len(last)


def test_near_stage_keeps_one_of_each_group(stages):
    want = {i for i, _, _, kept in near_brute([(i, r.text) for i, r in rows(stages[2]).items()], 5) if kept}
    assert set(rows(stages[3])) == want and stages[3].count() == len(want)


def test_mix_stage_meets_the_targets(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, taken, longest = {}, {}, {}
    for r in stages[3].collect():
        totals[r.source] = totals.get(r.source, 0) + size(r.text)
        longest[r.source] = max(longest.get(r.source, 0), size(r.text))
    for r in stages[4].collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s, want in brute_targets(totals).items():
        assert abs(taken.get(s, 0) - want) <= longest[s]


def test_last_stage_encodes_every_row(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in stages[4].collect())
    assert sorted((r.doc_id, r.ids) for r in stages[5].collect()) == want
    for r in stages[5].collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def test_odd_rows_pass_every_stage(spark):
    odd = [(None, "n o i d", "en", None, None), (None, "n o i d", "en", None, 1), (1, None, None, "a", 2), (2, "", None, "a", 3), (3, "same text", "x", "b", 4), (3, "same text", "x", "b", 4), (4, "SAME text", "x", "b", 5), (5, "long " * 30_000, "x", None, 6)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = keep_last(docs).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:9]) for r in kept) == [("2", ""), ("4", "SAME text"), ("5", "long long"), ("None", "n o i d")]
    one = written(keep_one(docs), "odd")
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "3", "5", "None"]
    assert sum(len((r.text or "").split()) for r in take_mix(docs).collect()) > 0
    empty = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (keep_last(empty), keep_one(empty), take_mix(empty)):
        assert out.columns == docs.columns and out.count() == 0
    assert train(empty, labels).bias == 0
