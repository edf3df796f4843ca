"""Documents to training tokens: the stages in order, each on all that the one before it kept.

Every stage works on whole tables through the operators in ``tickpulse.llm``.  The
first four return the columns of ``documents``; the last returns the token ids.

All stages take null, empty and very long texts, null and repeated ids, repeated rows, empty tables and columns of any
other name: a null text counts as empty, ties go as each stage says, an empty table gives an empty one, and further
columns stay as they are up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickpulse.llm.exact_dedup import keep_last
from tickpulse.llm.minhash_join import keep_one
from tickpulse.llm.mixing import take_mix
from tickpulse.llm.quality import keep_good, train
from tickpulse.llm.scratch import small_batches, written
from tickpulse.llm.word_bpe import compile_lexicon, encode_decode


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject (score of 0.3 or more); empty texts are scored by their structure."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the document with the largest id; all empty texts are equal."""
    small_batches(spark)
    return keep_last(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles, the smallest id; texts without words stay.

    Five words are what near-duplicate stages take unless a contract says otherwise; the contract of the registered query of
    the same operator says two."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document that it takes twice is two rows, one without words is never taken."""
    return take_mix(docs)


def encode_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every row of the mix."""
    small_batches(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return encode_decode(docs, tokenizer, compile_lexicon(docs, tokenizer), with_text=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("transducer_bpe", encode_words),
]
#: The learned score and the tokenizer have no SQL form; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``; what each stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
