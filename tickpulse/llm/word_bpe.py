"""Word-level BPE over a memory-mapped lexicon: encode whole texts, decode the ids again.

Frequent words of the corpus and their ids are compiled once into a minimal
acyclic transducer (``transducer``).  Tasks look their distinct words up there;
words that it does not hold are merged by the tokenizer's own model, so the ids
never depend on what the lexicon contains.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickpulse.llm import pretokens, rolling
from tickpulse.llm.files import map_file, write_file
from tickpulse.llm.scratch import fresh_path
from tickpulse.llm.transducer import Transducer, build

_ENCODERS: dict[tuple, WordEncoder] = {}
_SLICE = 1 << 20


class WordEncoder:
    """Encodes as the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, lexicon: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = pretokens.PieceModel(self.tokenizer)
        self.lexicon = Transducer(map_file(lexicon)) if lexicon else None
        self.pieces = pretokens.PieceTable(self._ids)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.strings = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self._fold_table()

    @classmethod
    def load(cls, path: str, lexicon: str | None = None) -> WordEncoder:
        if (path, lexicon) not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[path, lexicon] = cls(path, lexicon)
        return _ENCODERS[path, lexicon]

    def _fold_table(self) -> None:
        """What the normalizer makes of single code points, where that is one code point of the same UTF-8 length and
        cannot combine with its neighbours; other texts are left to the library."""
        kind = pretokens.class_table()
        self.fold = np.zeros(0x110000, np.uint32)
        self.simple = np.zeros(0x110000, bool)
        for c in [*range(0x300), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]:
            one = self.tokenizer.normalizer.normalize_str(chr(c))
            if len(one) == 1 and len(one.encode()) == len(chr(c).encode()) and not unicodedata.combining(chr(c)) and kind[c] != pretokens.UNSURE:
                self.fold[c], self.simple[c] = ord(one), True
            elif kind[c] == pretokens.SPACE:  # becomes a blank and separates words all the same
                self.fold[c], self.simple[c] = c, True

    def _ids(self, words: list[str]) -> list[list[int]]:
        if self.lexicon is None:
            return self.merge(words)
        numbers = self.lexicon.numbers([w.encode() for w in words]).tolist()
        unseen = iter(self.merge([w for w, n in zip(words, numbers) if n < 0]))
        return [next(unseen) if n < 0 else self.lexicon.output(n) for n in numbers]

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """Normalised bytes, word starts and ends in them, the text of each word, and the texts left to the library."""
        points, ends, at = pretokens.code_points(data, offsets)
        odd = set((np.searchsorted(ends, np.flatnonzero(~self.simple[points]), side="right") - 1).tolist())
        raw = data.tobytes()
        for mark in self.special:
            p = raw.find(mark)
            while p >= 0:
                odd.add(int(np.searchsorted(offsets, p, side="right") - 1))
                p = raw.find(mark, p + 1)
        points = np.where(self.simple[points], self.fold[points], points)
        if at is None:
            folded = points.astype(np.uint8)
        else:
            folded = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        start, end = pretokens.split_words(points, ends, pretokens.class_table()[points])
        owner = np.searchsorted(ends, start, side="right") - 1
        if at is not None:
            start, end = at[start], at[end]
        if odd:
            keep = ~np.isin(owner, list(odd))
            start, end, owner = start[keep], end[keep], owner[keep]
        return folded, start, end, owner, odd

    def encode(self, texts: pa.Array):
        """Yields the ids of each text in turn."""
        data, offsets = rolling.utf8_buffer(texts)
        first, n = 0, len(offsets) - 1
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + _SLICE, side="left"))
            last = min(max(last, first + 1), n)
            part, off = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            folded, start, end, owner, odd = self.words(part, off)
            place, s, z = self.pieces.look_up(folded, start, end)
            ids, each = self.pieces.expand(place, s, z)
            count = np.bincount(owner, weights=each, minlength=last - first).astype(np.int64)
            for i, x in enumerate(np.split(ids, np.cumsum(count)[:-1])):
                if i in odd:
                    text = part[off[i] : off[i + 1]].tobytes().decode()
                    x = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
                yield x
            first = last

    def decode(self, ids: np.ndarray) -> bytes:
        """As the library's ``decode(ids, skip_special_tokens=False)``: this vocabulary has no decoder, tokens are joined by blanks."""
        strings = self.strings
        return b" ".join([strings[i] for i in ids.tolist()])


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """How often each normalised word occurs: counted per task first, so a very common word is one row per task."""

    def count(batches):
        encoder = WordEncoder.load(tokenizer)
        seen: dict[int, list] = {}
        for b in batches:
            data, offsets = rolling.utf8_buffer(b.column(0))
            first, n = 0, len(offsets) - 1
            while first < n:
                last = min(max(int(np.searchsorted(offsets, offsets[first] + _SLICE, side="left")), first + 1), n)
                folded, start, end, _, _ = encoder.words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                h = rolling.span_hashes(rolling.prefix_hashes(folded), start, end)
                distinct, at, times = np.unique(h, return_index=True, return_counts=True)
                raw = folded.tobytes()
                for key, i, k in zip(distinct.tolist(), at.tolist(), times.tolist()):
                    if key in seen:
                        seen[key][1] += k
                    else:
                        seen[key] = [raw[start[i] : end[i]], k]
                if len(seen) > 300_000:
                    yield _word_batch(seen)
                    seen.clear()
                first = last
        yield _word_batch(seen)

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _word_batch(seen: dict[int, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen.values()], pa.binary()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["word", "n"])


def compile_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = 50_000) -> str:
    """Write the transducer of the ``words`` most frequent words of all texts to the shared folder; returns its path.

    The number of words bounds the file; it decides how often a word is looked up rather than merged, never the ids.  The
    words are merged in tasks: the driver holds words and ids, no tokenizer.
    """
    spark = docs.sparkSession
    top = word_counts(docs, tokenizer, text_col).orderBy(F.desc("n"), "word").limit(words).select("word")

    def merged(batches):
        merge = WordEncoder.load(tokenizer).merge
        for b in batches:
            ids = merge([w.decode() for w in b.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.list_(pa.int64()))], names=["word", "ids"])

    found = sorted((bytes(r.word), r.ids) for r in top.mapInArrow(merged, "word binary, ids array<long>").toLocalIterator())
    path = fresh_path(spark, "lexicon") + "/words.matw"
    write_file(path, build([w for w, _ in found], [ids for _, ids in found]))
    return path


def encode_decode(docs: DataFrame, tokenizer: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` and ``decoded`` of every row.

    ``ids_sha256`` is that of the ids as little-endian unsigned 32-bit integers.  Null texts are empty; null ids stay null; rows
    that repeat give rows that repeat; other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encoder = WordEncoder.load(tokenizer, lexicon)
        for b in batches:
            n, a, d, ids, texts = [], [], [], [], []
            for x in encoder.encode(b.column("text")):
                decoded = encoder.decode(x)
                n.append(len(x))
                a.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids.append(x.astype(np.int32))
                if with_text:
                    texts.append(decoded.decode())
            out = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(d, pa.string())}
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
            if with_text:
                out["decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return base.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text)
