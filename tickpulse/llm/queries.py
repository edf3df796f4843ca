"""The registered queries of the subpackage: each runs one operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickpulse.llm.collocations import collocations
from tickpulse.llm.exact_dedup import exact_dedup
from tickpulse.llm.histogram_sort import shard
from tickpulse.llm.learned_partitions import search
from tickpulse.llm.line_dedup import dedup_units
from tickpulse.llm.minhash_join import near_duplicates
from tickpulse.llm.mixing import mix
from tickpulse.llm.periodic_runs import periodic_runs
from tickpulse.llm.quality import score, train
from tickpulse.llm.scratch import fresh_path
from tickpulse.llm.signature_trees import jaccard_join
from tickpulse.llm.substring_sa import remove_repeats
from tickpulse.llm.token_files import read_tokens, write_tokens
from tickpulse.llm.word_bpe import compile_lexicon, encode_decode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query(
    r"""
    WITH b AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, sum(size)::DOUBLE AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM b GROUP BY source),
    l AS (
      SELECT *, (sum(total) OVER () - coalesce(sum(3 * total) OVER (ORDER BY 3 * total / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY 3 * total / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM s),
    t AS (
      SELECT source, total, least(3 * total, weight * (SELECT max(level) FROM l WHERE level * weight <= 3 * total)) AS target FROM l),
    r AS (
      SELECT doc_id, b.source, size, total, target, CASE WHEN size > 0 AND target > 0 THEN round(least(3, target / total), 7) ELSE 0 END AS rate,
             ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS place
      FROM b JOIN t ON t.source IS NOT DISTINCT FROM b.source),
    q AS (
      SELECT *, floor(rate) AS whole, rate - floor(rate) AS part, CASE WHEN rate > floor(rate) THEN place / (rate - floor(rate)) END AS q FROM r),
    o AS (
      SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS owed,
             coalesce(sum(size) OVER (PARTITION BY source, part > 0 ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM q)
    SELECT doc_id, size, total::BIGINT AS source_size, target,
           (size * (whole + CASE WHEN part > 0 AND before + size / 2 <= owed THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM o
    """
)
def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM n WINDOW g AS (PARTITION BY t)
    """
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
      FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (
      SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
    l AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
    r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
    c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """
)
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query()
def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder, manifest, with_ids=False)


@query()
def op5_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return encode_decode(docs, tokenizer, compile_lexicon(docs, tokenizer), with_ids=False, with_text=False)


@query(
    # a line feed right after another one ends a paragraph: that is the line feed after an empty line other than the first
    r"""
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
    g AS (
      SELECT *, coalesce(sum(CASE WHEN k > 0 AND line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM l),
    x AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY k) AS unit FROM g GROUP BY doc_id, pos),
    n AS (
      SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_units,
             regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words,
             coalesce(sum(strlen(unit) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM x),
    r AS (SELECT *, len(words) > 0 AND row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) > 1 AS gone FROM n)
    SELECT doc_id, n_units, count(*) FILTER (gone) AS n_removed, coalesce(sum(strlen(unit)) FILTER (gone), 0)::BIGINT AS removed_bytes,
           coalesce(string_agg(start::BIGINT || '-' || (start + strlen(unit))::BIGINT, ',' ORDER BY pos) FILTER (gone), '') AS removed_spans,
           sha256(coalesce(string_agg(unit, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM r GROUP BY doc_id, n_units
    """
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By paragraphs: a line of a few words that recurs by chance does not tear a clean text, a repeated passage still goes."""
    out = dedup_units(table(spark, sf_dir, "documents"), paragraphs=True, with_text=False)
    spans = F.concat_ws(",", F.transform(F.coalesce("spans", F.array()), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))
    return out.select("doc_id", "n_units", "n_removed", "removed_bytes", spans.alias("removed_spans"), "kept_sha256")


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


@query()
def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


@query(
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
             regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
      FROM documents),
    w AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
    p AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    g AS (SELECT lang, m, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') AS phrase FROM p, range(1, 6) r(m) WHERE i + m - 1 <= len(w)),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
    x AS (
      SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM c JOIN n USING (lang)
      JOIN f l ON l.lang = c.lang AND l.phrase = list_aggregate(c.w[1 : k], 'string_agg', ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = list_aggregate(c.w[k + 1 : c.m], 'string_agg', ' ')),
    b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    s AS (
      SELECT lang, f, w[i : i + z - 1] AS part
      FROM (SELECT lang, f, m, string_split(phrase, ' ') AS w, unnest(range(1, m + 1)) AS i FROM f WHERE m > 2), range(2, 5) y(z)
      WHERE z < m AND i + z - 1 <= m),
    o AS (SELECT lang, list_aggregate(part, 'string_agg', ' ') AS phrase, max(f) AS longer FROM s GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
    FROM b LEFT JOIN o USING (lang, phrase)
    WHERE longer IS NULL OR 100 * longer < 100 * a
    QUALIFY rank <= 2000
    """
)
def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), planted=True, with_text=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query(
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id,
             unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g
      FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (
      SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
    l AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
    r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
    c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
    FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """
)
def op13_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
