"""Periodic runs of words by an enhanced suffix array and the branching-tandem test.

Per document the words are numbers and the suffix array of the word sequence is built by doubling; the ranks of all
doubling rounds are kept, so the LCP table and backward extensions are looked up in them exactly (no text hashes).

A boundary ``p`` of the suffix array with ``lcp[p] = d`` parts an LCP interval of depth ``d`` in two: the child that ends before ``p`` and
the children from ``p`` on.  Every suffix ``i`` of the smaller part is tested: where ``ISA[i + d]`` or ``ISA[i - d]`` lies in the other part, the two
suffixes share exactly ``d`` words, so a square of period ``d`` ends where its period does (a branching tandem).  Enumerating only smaller parts
bounds the tests by n log n, and no tree node is ever made: the parts are two searches in a pyramid of minima over the LCP table.
Rotating a square to the left as far as the words allow gives its run; runs with the same span are merged to their smallest
period.  All documents of a slice are worked on together, with the document as the first key of every rank.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickpulse.llm import rolling
from tickpulse.llm.lyndon_sa import _flat_ranges

_BATCH_BYTES = 1 << 20
_TESTS = 1 << 20  # suffixes tested at once


class _Ranks:
    """Suffix array of all documents of a slice, and ``rank[l][i]``: equal for two places of a document iff their next 2**l words are equal.

    ``word`` numbers the words, ``stop[i]`` is the end of the document of place ``i``.
    """

    def __init__(self, word: np.ndarray, row: np.ndarray, stop: np.ndarray):
        n = len(word)
        key = row.astype(np.int64) * (int(word.max()) + 1 if n else 1) + word
        self.sa = np.argsort(key, kind="stable")
        ordered = key[self.sa]
        first = np.ones(n, bool)
        first[1:] = ordered[1:] != ordered[:-1]
        group = np.flatnonzero(first)
        rank = np.empty(n, np.int64)
        size = np.diff(np.append(group, n))
        rank[self.sa] = np.repeat(group, size)
        self.rank = [rank]
        open_ = np.repeat(size > 1, size)  # slots of the suffix array that still hold ties
        step = 1
        while open_.any():
            slots = np.flatnonzero(open_)
            at = self.sa[slots]
            head = rank[at]
            ahead = np.full(len(at), -1, np.int64)
            inside = at + step < stop[at]
            ahead[inside] = rank[at[inside] + step]
            order = np.lexsort((ahead, head))  # groups stay where they are, members are ordered
            at, head, ahead = at[order], head[order], ahead[order]
            self.sa[slots] = at
            new = np.ones(len(at), bool)
            new[1:] = (head[1:] != head[:-1]) | (ahead[1:] != ahead[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(at)))
            rank = rank.copy()
            rank[at] = np.repeat(slots[start], size)
            self.rank.append(rank)
            open_ = open_.copy()
            open_[slots] = np.repeat(size > 1, size)
            step *= 2
        self.isa = rank

    def lcp(self, stop: np.ndarray) -> np.ndarray:
        """``lcp[p]``: words that the suffixes at ``p - 1`` and ``p`` share; 0 between documents and at 0."""
        n = len(self.sa)
        out = np.zeros(n, np.int64)
        level0 = self.rank[0]
        p = 1 + np.flatnonzero(level0[self.sa[1:]] == level0[self.sa[:-1]]) if n else np.empty(0, np.int64)
        a, b, have = self.sa[p - 1].copy(), self.sa[p].copy(), np.zeros(len(p), np.int64)
        for level in range(len(self.rank) - 1, -1, -1):
            ok = np.flatnonzero((a < stop[self.sa[p - 1]]) & (b < stop[self.sa[p]]))
            r = self.rank[level]
            ok = ok[r[a[ok]] == r[b[ok]]]
            a[ok] += 1 << level
            b[ok] += 1 << level
            have[ok] += 1 << level
        out[p] = have
        return out

    def common_before(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words before ``i`` equal the words before ``j`` (``begin <= i < j``, one document)."""
        left, gap = i.copy(), j - i
        for level in range(len(self.rank) - 1, -1, -1):
            r, size = self.rank[level], 1 << level
            ok = np.flatnonzero(left - size >= begin)
            back = left[ok] - size
            left[ok[r[back] == r[back + gap[ok]]]] -= size
        return i - left


class _Minima:
    """Nearest smaller entries by a pyramid of minima; every search takes a step per level up and one down."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while len(self.levels[-1]) > 1:
            y = self.levels[-1]
            if len(y) % 2:
                y = np.append(y, np.iinfo(np.int64).max)
            self.levels.append(np.minimum(y[::2], y[1::2]))

    def _seek(self, at: np.ndarray, limit: np.ndarray, left: bool) -> np.ndarray:
        """Nearest index left or right of ``at`` with an entry below ``limit``; -1 or the length where there is none."""
        n = len(self.levels[0])
        out = np.full(len(at), -1 if left else n, np.int64)
        node, level_of = at.copy(), np.full(len(at), -1, np.int64)
        going = np.arange(len(at))
        for level in range(len(self.levels)):
            x = self.levels[level]
            here = node[going]
            side = (here & 1) == (1 if left else 0)
            beside = here - 1 if left else here + 1
            ok = side & (beside >= 0) & (beside < len(x))
            ok[ok] = x[beside[ok]] < limit[going[ok]]
            hit = going[ok]
            node[hit] = beside[ok]
            level_of[hit] = level
            going = going[~ok]
            if not len(going):
                break
            node[going] >>= 1
        for level in range(int(level_of.max(initial=-1)), 0, -1):
            down = np.flatnonzero(level_of == level)
            child = 2 * node[down] + (1 if left else 0)  # the nearer child first
            x = self.levels[level - 1]
            near = np.zeros(len(down), bool)
            there = child < len(x)
            near[there] = x[child[there]] < limit[down[there]]
            node[down] = np.where(near, child, child + (-1 if left else 1))
            level_of[down] = level - 1
        done = level_of == 0
        out[done] = node[done]
        return out

    def left_at_most(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self._seek(at, value + 1, True)

    def right_below(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self._seek(at, value, False)


def branching_squares(ranks: _Ranks, lcp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square whose period ends with it: the two suffixes a period apart share exactly one period."""
    n = len(lcp)
    p = np.flatnonzero(lcp)
    if not len(p):
        return p, p
    depth = lcp[p]
    pyramid = _Minima(lcp)
    low = np.maximum(pyramid.left_at_most(p, depth), 0)  # the child before p: low .. p - 1
    high = pyramid.right_below(p, depth)  # the children from p on: p .. high - 1
    fewer_left = p - low <= high - p
    begin, size = np.where(fewer_left, low, p), np.where(fewer_left, p - low, high - p)
    from_, to = np.where(fewer_left, p, low), np.where(fewer_left, high, p)
    starts, periods = [], []
    total = np.cumsum(size)
    first = 0
    while first < len(p):  # bounded slices of the tests
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + _TESTS, side="right")))
        s = size[first:last]
        i = ranks.sa[_flat_ranges(begin[first:last], s)]
        d, lo, hi = (np.repeat(x[first:last], s) for x in (depth, from_, to))
        for other, square in ((i + d, i), (i - d, i - d)):
            ok = np.flatnonzero((other >= 0) & (other < n))
            ok = ok[(ranks.isa[other[ok]] >= lo[ok]) & (ranks.isa[other[ok]] < hi[ok])]
            starts.append(square[ok])
            periods.append(d[ok])
        first = last
    return np.concatenate(starts), np.concatenate(periods)


def word_runs(word: np.ndarray, row: np.ndarray, begin: np.ndarray, stop: np.ndarray, least: int, times: int):
    """``place of the first word, length, period`` of the runs of all documents, ordered by start and period.

    ``begin`` and ``stop`` hold, for every place, the bounds of its document.
    """
    if not len(word):
        return (np.empty(0, np.int64),) * 3
    ranks = _Ranks(word, row, stop)
    square, period = branching_squares(ranks, ranks.lcp(stop), row)
    back = ranks.common_before(square, square + period, begin[square]) if len(square) else square
    start, end = square - back, square + 2 * period
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), bool)  # of one span the smallest period is the period
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    ok = end - start >= np.maximum(least, times * period)
    start, length, period = start[ok], (end - start)[ok], period[ok]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def planted_repeat(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """``a, p`` where the words of the document from ``a`` on repeat with period ``p``; None where the text stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, planted: bool = False, with_text: bool = True) -> DataFrame:
    """Runs of words that repeat with a period, and the text without the repetitions; one row per document.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch with smallest period ``q`` and at least ``max(least, times * q)`` words that no
    neighbouring word extends.  Returns ``doc_id, n_words, n_runs, start, length, period, exponent_milli`` (of the longest run; ties: smallest start,
    then period; nulls without runs), ``runs_sha256, collapsed_sha256`` and, with ``with_text``, ``runs`` (``start, length, period``) and
    ``collapsed`` (the words no run holds after its first period, joined by blanks).  ``planted`` first repeats words of every tenth document by id.

    A null, empty or wordless text has no words and no runs.  Ids may be null (never planted) or repeat; each row stands for itself, equal
    rows give equal results.  A very long text is one slice of its own; memory is a few numbers per word and doubling round.  An
    empty table gives no rows, and other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if with_text:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def work(batches):
        for b in batches:
            data, offsets = rolling.utf8_buffer(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            first = 0
            while first < len(ids):
                last = int(np.searchsorted(offsets, offsets[first] + _BATCH_BYTES, side="left"))
                last = min(max(last, first + 1), len(ids))
                yield _slice_rows(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], ids[first:last], least, times, planted, with_text)
                first = last

    return base.mapInArrow(work, schema)


def _slice_rows(data: np.ndarray, offsets: np.ndarray, ids: list, least: int, times: int, planted: bool, with_text: bool) -> pa.RecordBatch:
    begin, end, row = rolling.word_spans(data, offsets)
    count = np.bincount(row, minlength=len(ids))
    head = np.cumsum(count) - count
    raw = data.tobytes()
    words = [raw[a:z] for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
    numbers: dict[bytes, int] = {}
    word = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    for k, doc_id in enumerate(ids):
        if planted and (plan := planted_repeat(doc_id, int(count[k]))):
            a, p = plan
            at = head[k] + a + np.arange(count[k] - a) % p
            word[head[k] + a : head[k] + count[k]] = word[at]
    spelled = list(numbers)
    low, high = np.repeat(head, count), np.repeat(head + count, count)
    start, length, period = word_runs(word, row, low, high, least, times)
    doc = row[start] if len(start) else np.empty(0, np.int64)
    # words after the first period of any run
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    n_runs = np.bincount(doc, minlength=len(ids))
    run_head = np.cumsum(n_runs) - n_runs
    local = start - head[doc] if len(start) else start
    cols: list[list] = [[] for _ in range(8)]
    for k in range(len(ids)):
        r = slice(run_head[k], run_head[k] + n_runs[k])
        runs = list(zip(local[r].tolist(), length[r].tolist(), period[r].tolist(), strict=True))
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        mine = slice(head[k], head[k] + count[k])
        left = b" ".join(spelled[x] for x in word[mine][kept[mine]].tolist())
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out = (*top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
        for c, v in zip(cols, (*out, [dict(start=s, length=n, period=q) for s, n, q in runs], left), strict=True):
            c.append(v)
    long = pa.int64()
    arrays = [pa.array(ids, long), pa.array(count, long), pa.array(n_runs, long), *[pa.array(c, long) for c in cols[:4]], pa.array(cols[4]), pa.array(cols[5])]
    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    if with_text:
        arrays += [pa.array(cols[6], pa.list_(pa.struct([(x, long) for x in ("start", "length", "period")]))), pa.array(cols[7], pa.binary()).cast(pa.string())]
        names += ["runs", "collapsed"]
    return pa.RecordBatch.from_arrays(arrays, names=names)
