"""Exact deduplication of a new batch against immutable snapshots.

A snapshot is a written table of distinct normalised texts (SHA-256, length,
smallest facts of the group) dealt into buckets of the digest, plus one static
binary-fuse filter per bucket.  Both are written once and never changed.  A new
batch is first grouped by itself; its distinct digests are screened by the
filters, only the positives meet the exact buckets, and a positive counts as a
copy only when the normalised bytes of both representatives are equal.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickpulse.llm import rolling
from tickpulse.llm.rows import chosen_rows
from tickpulse.llm.scratch import fresh_path, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# --- binary-fuse filter -----------------------------------------------------------


def _places(keys: np.ndarray, seed: int, segment: int, segments: int):
    """The three slots of each key in three neighbouring segments, and its 8-bit fingerprint."""
    with np.errstate(over="ignore"):
        h = rolling.mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    mask = np.uint64(segment - 1)
    a = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    b = (a + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    c = (a + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([a, b, c]).astype(np.int64), (h ^ (h >> np.uint64(40))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Static filter over distinct 64-bit keys: seed, segment length, number of start segments, fingerprints.

    Slots that hold a single key are peeled round by round; fingerprints are set in the reverse order.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 4 if n < 2 else min(1 << 18, 1 << int(np.log(n) / np.log(3.33) + 2.25))
    factor = 2.0 if n < 2 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    segments = max(1, int(np.ceil(n * factor / segment)) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 1000):
        slots, prints = _places(keys, seed, segment, segments)
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        number = np.arange(n)
        for s in slots:
            np.bitwise_xor.at(owner, s, number)
        rounds, left = [], n
        single = np.flatnonzero(count == 1)
        while len(single):
            who, at = np.unique(owner[single], return_index=True)
            rounds.append((who, single[at]))
            left -= len(who)
            hit = slots[:, who].ravel()
            np.subtract.at(count, hit, 1)
            np.bitwise_xor.at(owner, hit, np.tile(who, 3))
            single = np.unique(hit)
            single = single[count[single] == 1]
        if left == 0:
            table = np.zeros(size, np.uint8)
            for who, slot in reversed(rounds):
                x = slots[:, who]
                table[slot] = prints[who] ^ table[x[0]] ^ table[x[1]] ^ table[x[2]]
            return seed, segment, segments, table.tobytes()
        if seed % 20 == 0:  # unlucky sizes get a little more room
            segments += max(1, segments // 10)
            size = (segments + 2) * segment
    raise ValueError("no seed peels the filter")


def filter_has(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """True for every key of the filter, and for about 1 of 256 others."""
    slots, prints = _places(keys.astype(np.uint64), seed, segment, segments)
    t = np.frombuffer(table, np.uint8)
    return prints == t[slots[0]] ^ t[slots[1]] ^ t[slots[2]]


# --- digests and snapshots --------------------------------------------------------


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (id, normalised text): ``doc_id, sha, n_bytes, digest, raw`` and how many rows repeat it.

    Normalised: A-Z in lower case, null as empty.  ``raw`` tells texts of one id apart.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("raw", F.xxhash64(F.coalesce("text", F.lit(""))))

    def digest(batches):
        for b in batches:
            data, offsets = rolling.utf8_buffer(b.column("text"))
            view = memoryview(rolling.lower_az(data))
            sha = [hashlib.sha256(view[s:e]).digest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            head = np.frombuffer(b"".join(x[:8] for x in sha), np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sha, pa.binary()), pa.array(np.diff(offsets), pa.int64()), pa.array(head, pa.int64()), b.column("raw")],
                names=["doc_id", "sha", "n_bytes", "digest", "raw"],
            )

    rows = base.mapInArrow(digest, "doc_id long, sha binary, n_bytes long, digest long, raw long")
    return rows.groupBy("doc_id", "sha", "n_bytes", "digest").agg(F.min("raw").alias("raw"), F.count("*").alias("copies"))


def groups_of(rows: DataFrame) -> DataFrame:
    """Distinct texts of digest rows: the largest id (null only if all are null), the row count and a representative."""
    return rows.groupBy("digest", "sha", "n_bytes").agg(
        F.max("doc_id").alias("keep_id"),
        F.sum("copies").alias("group_size"),
        F.max(F.struct("doc_id", "raw")).alias("rep"),
    )


@dataclass(frozen=True)
class Snapshot:
    """Paths and bucket count of a written, immutable snapshot."""

    exact: str
    filters: str
    buckets: int


def write_snapshot(rows: DataFrame, bucket_keys: int = 500_000) -> Snapshot:
    """Write the distinct texts of digest rows and one filter per digest bucket."""
    spark = rows.sparkSession
    exact, filters = fresh_path(spark, "snapshot"), fresh_path(spark, "filters")
    groups_of(rows).write.parquet(exact)
    table = spark.read.parquet(exact)
    buckets = max(1, -(-table.count() // bucket_keys))

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, prints = build_filter(keys["digest"].to_numpy())
        return pd.DataFrame([(int(keys["bucket"].iloc[0]), seed, segment, segments, prints)], columns=["bucket", "seed", "segment", "segments", "prints"])

    (
        table.select("digest", F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInPandas(build, "bucket long, seed long, segment long, segments long, prints binary")
        .write.parquet(filters)
    )
    return Snapshot(exact, filters, buckets)


def screen(incoming: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The incoming groups whose digest may be in the snapshot."""
    filters = incoming.sparkSession.read.schema("bucket long, seed long, segment long, segments long, prints binary").parquet(snapshot.filters)
    keyed = incoming.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(snapshot.buckets)))

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.slice(0, 0)
        f = right.to_pylist()[0]
        has = filter_has(left.column("digest").to_numpy(), f["seed"], f["segment"], f["segments"], f["prints"])
        return left.filter(pa.array(has))

    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, keyed.schema).drop("bucket")


def _same_bytes(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Keep the pairs (``old`` and ``new`` representatives) whose normalised bytes are equal."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("t_id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("t_raw"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t_text"),
    )
    ends = pairs.select("digest", "sha", "n_bytes", F.explode(F.array(F.col("old").alias("o"), F.col("new").alias("o"))).alias("end")).distinct()
    # always by a shuffle on both sides: the number of pairs grows with the copies, and the plan stays the same at every size
    found = ends.hint("merge").join(texts, F.col("end.doc_id").eqNullSafe(F.col("t_id")) & (F.col("end.raw") == F.col("t_raw")))
    normal = F.translate("t_text", _UPPER, _UPPER.lower())
    agree = found.groupBy("digest", "sha", "n_bytes").agg((F.min(normal) == F.max(normal)).alias("agree"))
    return agree.where("agree").drop("agree")


def dedup_batch(docs: DataFrame, rows: DataFrame, snapshot: Snapshot, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of snapshot and batch together: ``sha, n_bytes, keep_id, group_size``.

    ``rows`` are the digest rows of the batch; ``docs`` must hold the texts of snapshot and batch.
    """
    spark = docs.sparkSession
    old = spark.read.parquet(snapshot.exact)
    new = written(groups_of(rows), "batch-groups")
    positive = screen(new, snapshot)
    key = ["digest", "sha", "n_bytes"]
    pairs = written(
        positive.select(*key, F.col("rep").alias("new")).join(old.select(*key, F.col("rep").alias("old")), key), "pairs"
    )
    equal = _same_bytes(docs, pairs, id_col, text_col).withColumn("equal", F.lit(True))
    side = [*key, "keep_id", "group_size"]
    both = old.select(*side, F.lit(0).alias("side")).unionByName(new.select(*side, F.lit(1).alias("side"))).join(equal, key, "left")
    # texts whose bytes differ under one digest would stay apart: the side then tells them from each other
    apart = F.when(F.col("equal"), F.lit(-1)).otherwise(F.col("side"))
    return both.groupBy(*key, apart.alias("part")).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_snapshot=None) -> DataFrame:
    """Mark every row with the document that stays for its text.

    ``in_snapshot`` is a condition on the id that tells the rows of the immutable
    snapshot from the new batch (default: half of the ids, by hash).  The result does
    not depend on it.  Returns ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The
    largest id stays; a null id stays only if the group has no other.  Of rows that repeat both
    id and text exactly one is kept.  Empty tables give no rows; other columns are ignored.
    """
    return _marked(docs, id_col, text_col, in_snapshot).drop("raw")


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest id.

    Null counts as empty; a null id stays only if the group has no other.  Of rows that repeat id and text one stays, chosen by a
    hash of all columns.  Columns of any name and type are returned as they are; an empty table stays empty.
    """
    marks = written(_marked(docs, id_col, text_col, None).where("kept").select("doc_id", "raw"), "kept")
    return chosen_rows(docs, marks, id_col, text_col)


def _marked(docs: DataFrame, id_col: str, text_col: str, in_snapshot) -> DataFrame:
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = written(digests(docs, id_col, text_col), "digests").withColumn("old", half if in_snapshot is None else in_snapshot)
    rows = rows.withColumn("old", F.coalesce("old", F.lit(False)))
    snapshot = write_snapshot(rows.where("old"))
    found = written(dedup_batch(docs, rows.where(~F.col("old")), snapshot, id_col, text_col), "groups")
    side = F.when(F.col("old"), F.lit(0)).otherwise(F.lit(1))
    out = rows.withColumn("side", side).join(
        found.withColumnRenamed("sha", "g_sha").withColumnRenamed("n_bytes", "g_n").withColumnRenamed("digest", "g_digest"),
        (F.col("digest") == F.col("g_digest")) & (F.col("sha") == F.col("g_sha")) & (F.col("n_bytes") == F.col("g_n")) & ((F.col("part") == -1) | (F.col("part") == F.col("side"))),
    )
    return out.select(
        "doc_id",
        "raw",
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    ).select("doc_id", "raw", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
