"""Vectorised splitting of texts into the pre-tokens of byte-pair tokenizers.

The two patterns below are those of the public vocabularies.  Texts are split on
whole-batch arrays of code points; the few texts that hold a letter or digit whose
class changed between Unicode versions, or the string of a special token, are
left to the tokenizer library itself.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd

from tickpulse.llm import rolling

OTHER, LETTER, NUMBER, SPACE, UNSURE = 0, 1, 2, 3, 4
_CLASS: list[np.ndarray] = []


def _class_of(category: str, c: int) -> int:
    if category[0] == "L":
        return LETTER
    if category[0] == "N":
        return NUMBER
    return SPACE if category[0] == "Z" or c in (9, 10, 11, 12, 13, 0x85) else OTHER


def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other; unsure where an old Unicode says otherwise."""
    if not _CLASS:
        out = np.zeros(0x110000, np.uint8)
        old = unicodedata.ucd_3_2_0
        for c in range(0x110000):
            ch = chr(c)
            now = _class_of(unicodedata.category(ch), c)
            if now or c < 0x30000:
                out[c] = now if now == _class_of(old.category(ch), c) else UNSURE
        _CLASS.append(out)
    return _CLASS[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Code points of a UTF-8 buffer, the texts' offsets in them, and the byte position of each (None: the same)."""
    if not (data & 0x80).any():
        return data, offsets, None
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.append(np.flatnonzero(lead), len(data))
    return points, np.searchsorted(at, offsets), at


def _runs_and_apostrophes(points: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Flags of class changes (never across texts), and contractions: index of the apostrophe and its length."""
    n = len(points)
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    run[inner] = True
    quote = np.flatnonzero((points == 39) & run)
    end = np.searchsorted(offsets, quote, side="right")
    stop = offsets[np.minimum(end, len(offsets) - 1)]  # end of the text
    one = np.where(quote + 1 < stop, points[np.minimum(quote + 1, n - 1)], 0)
    two = np.where(quote + 2 < stop, points[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    return run, quote, np.where(short, 2, np.where(long, 3, 0)), stop


def split_with_spaces(points: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    run, quote, width, stop = _runs_and_apostrophes(points, offsets, kind)
    begin = run.copy()
    space = kind == SPACE
    last = np.zeros(n, bool)  # last white space before a word of the same text
    last[:-1] = space[:-1] & run[1:] & ~space[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    last[cut - 1] = False
    at = np.flatnonzero(last)
    begin[at] = True
    begin[at[points[at] == 32] + 1] = False
    mine = (width > 0) & begin[quote]
    quote, width, stop = quote[mine], width[mine], stop[mine]
    begin[quote + 1] = False
    after = quote + width
    begin[after[after < stop]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n)


def split_words(points: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` (white space between is dropped)."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    run, quote, width, stop = _runs_and_apostrophes(points, offsets, kind)
    begin = run | (kind == NUMBER)
    mine = width > 0
    quote, width, stop = quote[mine], width[mine], stop[mine]
    begin[quote + 1] = False
    after = quote + width
    begin[after[after < stop]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    word = kind[starts] != SPACE
    return starts[word], ends[word]


class PieceTable:
    """Ids of the pre-tokens that this worker has met, kept by hash; at most ``most`` of them."""

    def __init__(self, encode, most: int = 2_000_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self):
        self.keys, self.start, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per pre-token (byte spans): number in the table; the table's starts and sizes in ``self.ids``."""
        h = rolling.span_hashes(rolling.prefix_hashes(data), starts, ends) ^ (ends - starts).astype(np.uint64)
        code, distinct = pd.factorize(h)
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        if not known.all():
            if len(self.keys) > self.most:
                self._clear()
                known[:] = False
            first = np.full(len(distinct), -1, np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            lists = self.encode([raw[starts[i] : ends[i]].decode() for i in first[new].tolist()])
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((x for ids in lists for x in ids), np.int64, int(sizes.sum()))
            keys = np.append(self.keys, distinct[new])
            start = np.append(self.start, len(self.ids) + np.cumsum(sizes) - sizes)
            size = np.append(self.size, sizes)
            order = np.argsort(keys)
            self.keys, self.start, self.size = keys[order], start[order], size[order]
            self.ids = np.append(self.ids, flat)
            place = np.searchsorted(self.keys, distinct)
        return place[code], self.start, self.size

    def expand(self, place: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and how many each has."""
        n = size[place]
        before = np.cumsum(n) - n
        return self.ids[np.repeat(start[place] - before, n) + np.arange(int(n.sum()))], n


def byte_alphabet() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceModel:
    """Merges of single pre-tokens by the tokenizers library's model."""

    def __init__(self, tokenizer):
        self.model, self.alphabet = tokenizer.model, byte_alphabet()

    def __call__(self, words: list[str]) -> list[list[int]]:
        merge, alphabet = self.model.tokenize, self.alphabet
        return [[t.id for t in merge(w.encode().decode("latin-1").translate(alphabet))] for w in words]
