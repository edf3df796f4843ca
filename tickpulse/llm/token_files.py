"""Token ids as wavelet-matrix files: encode, write shards in id order, read back."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickpulse.llm import pretokens, rolling
from tickpulse.llm.files import write_file
from tickpulse.llm.histogram_sort import _row_keys, key_columns, part_column, splitters
from tickpulse.llm.scratch import written
from tickpulse.llm.wavelet import WaveletMatrix, build

_ENCODERS: dict[str, ByteEncoder] = {}
_SLICE = 1 << 20


class ByteEncoder:
    """Byte-level BPE of whole texts with the tokenizers library, each distinct pre-token encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.pieces = pretokens.PieceTable(pretokens.PieceModel(self.tokenizer))

    @classmethod
    def load(cls, path: str) -> ByteEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _whole(self, raw: bytes) -> list[int]:
        return self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        flat, sizes = [], []
        first, n = 0, len(offsets) - 1
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + _SLICE, side="left"))
            last = min(max(last, first + 1), n)
            ids, count = self._encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            flat.append(ids)
            sizes.append(count)
            first = last
        return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, ends, at = pretokens.code_points(data, offsets)
        kind = pretokens.class_table()[points]
        start, end = pretokens.split_with_spaces(points, ends, kind)
        owner = np.searchsorted(ends, start, side="right") - 1
        if at is not None:
            start, end = at[start], at[end]
        place, s, z = self.pieces.look_up(data, start, end)
        ids, each = self.pieces.expand(place, s, z)
        count = np.bincount(owner, weights=each, minlength=len(offsets) - 1).astype(np.int64)
        raw = data.tobytes()
        odd = set((np.searchsorted(ends, np.flatnonzero(kind == pretokens.UNSURE), side="right") - 1).tolist())
        for mark in self.special:
            p = raw.find(mark)
            while p >= 0:
                odd.add(int(np.searchsorted(offsets, p, side="right") - 1))
                p = raw.find(mark, p + 1)
        if odd:  # whole texts through the library
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in odd:
                parts[i] = np.array(self._whole(raw[offsets[i] : offsets[i + 1]]), np.int64)
            ids, count = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, count


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = 8 << 20,
) -> DataFrame:
    """Encode every text, append ``end_id``, and write wavelet files of about ``shard_bytes`` of text in ascending id order.

    Returns the written manifest ``shard, n_docs, n_tokens, n_bytes, path``.  Null texts are empty (the end id only); null ids come
    first; rows with equal ids are ordered by a hash of their text.  Shards are cut by exact byte counts; one very long text
    is a shard of its own.  An empty table writes no files.  Other columns are ignored.
    """
    keyed = key_columns(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    keys = written(keyed.select(F.col("_value").alias("value"), F.col("_tie").alias("tie"), F.col("_size").alias("size")), "token-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts, _, _ = splitters(keys, max(1, -(-total // shard_bytes)), 0.2, 8)
    dealt = keyed.select("doc_id", "text", "_value", "_tie", part_column(cuts, F.col("_value"), F.col("_tie")).alias("shard"))

    def write(rows: pa.Table) -> pa.Table:
        encoder = ByteEncoder.load(tokenizer)
        rows = rows.take(pa.array(np.argsort(_row_keys(rows.column("_value").to_numpy(), rows.column("_tie").to_numpy()), kind="stable")))
        ids, count = encoder.encode(*rolling.utf8_buffer(rows.column("text")))
        ends = np.cumsum(count)
        ids = np.insert(ids, ends, end_id)
        starts = ends - count + np.arange(len(count))
        doc = rows.column("doc_id")
        content = build(ids, doc.fill_null(0).to_numpy(), ~doc.is_null().to_numpy(zero_copy_only=False), starts, max(encoder.bits, end_id.bit_length()))
        shard = rows.column("shard")[0].as_py()
        path = f"{folder}/tokens-{shard:08d}.wvlt"
        write_file(path, content)
        return pa.table({"shard": [shard], "n_docs": [len(count)], "n_tokens": [len(ids)], "n_bytes": [len(content)], "path": [path]})

    return written(dealt.groupBy("shard").applyInArrow(write, "shard long, n_docs long, n_tokens long, n_bytes long, path string"), "manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents read back from the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                w = WaveletMatrix(content)
                ids = w.tokens().astype("<u4")
                ends = np.append(w.starts[1:], w.n)
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(w.starts.tolist(), ends.tolist())]
                out = {
                    "shard": pa.array(np.full(len(crc), int(path.rpartition("-")[2].partition(".")[0]))),
                    "doc_id": pa.array(w.doc_ids, mask=~w.known),
                    "local": pa.array(w.starts),
                    "n_tokens": pa.array(ends - w.starts),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([ids[s:e].tolist() for s, e in zip(w.starts.tolist(), ends.tolist())], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    kinds = "shard long, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if manifest.isEmpty():
        rows = spark.createDataFrame([], kinds)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvlt").load(folder)
        rows = files.select("path", "content").mapInArrow(read, kinds)
    # tokens before each shard: before its group of shards, then inside the group
    group = F.floor(F.col("shard") / 4096)
    inside = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    groups = manifest.groupBy(group.alias("g")).agg(F.sum("n_tokens").alias("all"))
    groups = groups.withColumn("sum", F.coalesce(F.sum("all").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shards = manifest.select("shard", "n_tokens", group.alias("g")).withColumn("in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    before = written(shards.join(groups, "g").select("shard", (F.col("sum") + F.col("in")).alias("before")), "shard-starts")
    out = rows.join(before, "shard")
    return out.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
