"""Vectorised hashing over the concatenated bytes of an Arrow batch.

All functions work on one ``uint8`` buffer that holds many texts back to back;
``offsets`` (``n + 1`` entries) marks where each text starts.  Arithmetic is
modulo 2**64 on purpose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# odd multiplier of the polynomial hash, and its inverse modulo 2**64
_BASE = 0x9E3779B97F4A7C55
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` for i < n (kept for the next batch of the same worker)."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                out = np.empty(size, np.uint64)
                out[0] = 1
                filled = 1
                step = np.uint64(base)
                while filled < size:  # out[i + filled] = out[i] * base**filled
                    take = min(filled, size - filled)
                    out[filled : filled + take] = out[:take] * step
                    step = step * step
                    filled += take
                _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``P`` with ``P[j] - P[i]`` the unnormalised hash of ``data[i:j]``."""
    up, _ = _power_table(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each ``data[start:end]``; equal bytes give equal hashes in every batch."""
    _, down = _power_table(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts])


def all_kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``data[i:i+k]`` for every i (empty when the buffer is shorter than k)."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    prefix = prefix_hashes(data)
    _, down = _power_table(n)
    with np.errstate(over="ignore"):
        return mix((prefix[k:] - prefix[:-k]) * down)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``x[i:i+w]`` by doubling windows."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    have, cur = 1, x
    while have * 2 <= w:
        cur = np.minimum(cur[:-have], cur[have:])
        have *= 2
    return cur if have == w else np.minimum(cur[:n], cur[w - have : w - have + n])


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes and offsets of a string array; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    _, off, data = texts.buffers()
    if n == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.empty(0, np.uint8)
    return raw, offsets - first


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_az(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of every run of bytes outside ``gaps`` (never across texts).

    ``gaps`` is a table of 256 flags; as given it holds ``\\x20 \\x09-\\x0D``."""
    n = len(data)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e
    inside = ~gaps[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, owner
