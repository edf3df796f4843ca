"""Removal of repeated lines or paragraphs by global digests.

Every unit (line or paragraph) is normalised (A-Z lowered, white space between words
ignored) and digested to 128 bits.  Digests are grouped over all documents, the
occurrence that ranks first (document id, then place) stays, and all others are
cut.  Byte offsets always refer to the original text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickpulse.llm import rolling
from tickpulse.llm.scratch import written

_UNIT = "doc_id long, raw long, pos long, start long, stop long, words long, d1 long, d2 long"
_CHUNK = 1 << 20


def _units(data: np.ndarray, offsets: np.ndarray, paragraphs: bool):
    """Starts and ends (without the separator) of every unit, and its text; an empty text has one empty unit."""
    breaks = data == 10
    if paragraphs:  # a blank line: two line feeds in a row end a paragraph at the second
        two = np.zeros(len(data), bool)
        two[1:] = breaks[1:] & breaks[:-1]
        first = offsets[:-1]
        two[first[first < len(data)]] = False
        breaks = two
    at = np.flatnonzero(breaks)
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, at, side="right") - 1])
    begin = np.concatenate([offsets[:-1], at + 1])
    order = np.lexsort((np.concatenate([np.zeros(len(offsets) - 1), np.ones(len(at))]), begin, owner))
    start, owner = begin[order], owner[order]
    stop = np.append(start[1:], offsets[-1])
    last = np.ones(len(start), bool)
    last[:-1] = owner[1:] != owner[:-1]
    stop = np.where(last, offsets[owner + 1], stop - 1)
    return start, stop, owner


def _digests(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Words per unit and two hashes of its word sequence."""
    low = rolling.lower_az(data)
    begin, end, _ = rolling.word_spans(low, offsets)
    h = rolling.span_hashes(rolling.prefix_hashes(low), begin, end)
    a, b = np.searchsorted(begin, start), np.searchsorted(begin, stop)
    _, down = rolling._power_table(len(h) + 1)
    up, _ = rolling._power_table(len(h) + 1)
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x1B873593CC9E2D51, 0x52DCE72938495AB5):
            sums = np.append(np.uint64(0), np.cumsum(rolling.mix(h ^ np.uint64(salt)) * up[: len(h)]))
            out.append(rolling.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64))
    return b - a, *out


def unit_digests(docs: DataFrame, id_col: str, text_col: str, paragraphs: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("raw"), text.alias("text"))

    def digest(batches):
        for b in batches:
            data, offsets = rolling.utf8_buffer(b.column("text"))
            first, n = 0, len(offsets) - 1
            while first < n:
                last = min(max(int(np.searchsorted(offsets, offsets[first] + _CHUNK, side="left")), first + 1), n)
                part, off = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                start, stop, owner = _units(part, off, paragraphs)
                words, d1, d2 = _digests(part, off, start, stop)
                head = np.searchsorted(owner, np.arange(last - first))
                pick = pa.array(owner + first)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pick), b.column("raw").take(pick), *(pa.array(x.astype(np.int64)) for x in (np.arange(len(owner)) - head[owner], start - off[owner], stop - off[owner], words, d1, d2))],
                    names=["doc_id", "raw", "pos", "start", "stop", "words", "d1", "d2"],
                )
                first = last

    return base.mapInArrow(digest, _UNIT)


def dedup_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    paragraphs: bool = False,
    min_words: int = 1,
    with_text: bool = True,
) -> DataFrame:
    """Cut every unit of ``min_words`` words or more whose words occurred in an earlier unit, in any document.

    Returns one row per row of ``docs``: ``doc_id, n_units, n_removed, removed_bytes, spans, kept_sha256`` and, if asked for,
    ``kept``.  ``spans`` lists the cut units as ``start, end`` byte offsets in the original text with the document
    and offset of the occurrence that stays.  The kept units are joined by the separator (a line feed; between
    paragraphs what stood there).  Earlier: smaller document id (null last), then earlier in the text.

    By default only units without words (empty, or white space alone) are left out of this; they stay wherever they are.

    Null and empty texts have one empty unit, which stays.  Rows that repeat id and text count as one document, so each of them
    keeps what the document keeps.  Other columns are ignored; an empty table gives no rows.
    """
    units = written(unit_digests(docs, id_col, text_col, paragraphs), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw", "pos", "start")
    seen = units.where(F.col("words") >= min_words).select("d1", "d2", rank.alias("rank")).groupBy("d1", "d2").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    first = written(seen.where("n > 1").select(F.col("d1").alias("f1"), F.col("d2").alias("f2"), "first"), "repeated-units")
    later = (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("raw") == F.col("first.raw")) & (F.col("pos") == F.col("first.pos"))) == F.lit(False)
    gone = units.where(F.col("words") >= min_words).join(first, (F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2"))).where(later)
    span = F.struct("start", F.col("stop").alias("end"), F.col("first.doc_id").alias("first_id"), F.col("first.start").alias("first_start"))
    per = gone.groupBy("doc_id", "raw").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    per = written(per.select(F.col("doc_id").alias("s_id"), F.col("raw").alias("s_raw"), "spans"), "cut-spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("raw"), text.alias("text"))
    joined = base.join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("raw") == F.col("s_raw")), "left")

    def cut(batches):
        for b in batches:
            data, offsets = rolling.utf8_buffer(b.column("text"))
            n_units, n_removed, removed, sha, kept = [], [], [], [], []
            start, stop, owner = _units(data, offsets, paragraphs)
            head = np.searchsorted(owner, np.arange(len(offsets)))
            for i, spans in enumerate(b.column("spans").to_pylist()):
                lo = int(offsets[i])
                mine = list(zip(start[head[i] : head[i + 1]].tolist(), stop[head[i] : head[i + 1]].tolist()))
                out = data[lo : offsets[i + 1]].tobytes()
                if spans:
                    drop = {s["start"] for s in spans}
                    out = b"\n".join(data[s:e].tobytes() for s, e in mine if s - lo not in drop)
                n_units.append(len(mine))
                n_removed.append(len(spans or ()))
                removed.append(sum(s["end"] - s["start"] for s in spans or ()))
                sha.append(hashlib.sha256(out).hexdigest())
                kept.append(out.decode() if with_text else None)
            out = [b.column("doc_id"), pa.array(n_units, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.int64()), b.column("spans"), pa.array(sha, pa.string())]
            names = ["doc_id", "n_units", "n_removed", "removed_bytes", "spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.string())] * with_text, names=names + ["kept"] * with_text)

    kinds = "doc_id long, n_units long, n_removed long, removed_bytes long, spans array<struct<start:long,end:long,first_id:long,first_start:long>>, kept_sha256 string"
    return joined.select("doc_id", "text", "spans").mapInArrow(cut, kinds + (", kept string" if with_text else ""))
