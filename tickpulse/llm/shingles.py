"""Sets of word shingles, as hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tickpulse.llm import rolling

_BATCH_BYTES = 1 << 20


def shingle_sets(texts: pa.Array, words: int):
    """For slices of the texts: first row, distinct shingle hashes sorted per row, their row, first index and count per row.

    Words are runs of bytes other than ``\\x20 \\x09-\\x0D`` in the text with A-Z lowered.  A text with fewer than
    ``words`` words is one shingle; without words it has none.
    """
    data, offsets = rolling.utf8_buffer(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + _BATCH_BYTES, side="left"))
        last = min(max(last, first + 1), n)
        low = rolling.lower_az(data[offsets[first] : offsets[last]])
        start, end, row = rolling.word_spans(low, offsets[first : last + 1] - offsets[first])
        h = rolling.span_hashes(rolling.prefix_hashes(low), start, end)
        count = np.bincount(row, minlength=last - first)
        with np.errstate(over="ignore"):
            full = h
            for j in range(1, words):  # order-dependent mix of the next words
                m = max(0, len(h) - j)
                full = rolling.mix(full[:m] * np.uint64(0x9FB21C651E98DF25) + h[j:])
            at = np.arange(len(full))
            inside = row[at] == row[at + words - 1] if len(full) else np.empty(0, bool)
            g, r = full[inside], row[at][inside]
            short = np.flatnonzero((count > 0) & (count < words))
            if len(short):
                head = np.cumsum(count) - count
                extra = []
                for i in short.tolist():
                    x = np.uint64(count[i])
                    for y in h[head[i] : head[i] + count[i]]:
                        x = rolling.mix(np.array([x * np.uint64(0x9FB21C651E98DF25) + y + np.uint64(1)]))[0]
                    extra.append(x)
                g, r = np.append(g, np.array(extra, np.uint64)), np.append(r, short)
        order = np.lexsort((g, r))
        g, r = g[order], r[order]
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        g, r = g[keep], r[keep]
        size = np.bincount(r, minlength=last - first)
        yield first, g, r, np.cumsum(size) - size, size
        first = last
