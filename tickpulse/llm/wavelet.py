"""A wavelet matrix in one compressed file.

Token ids are stored as bit-planes from the highest bit down; each plane keeps the
ids in the order that a stable partition by the plane above left them in.  Planes
are cut into blocks that are compressed one by one, with the number of ones before
each block, so rank, select, access, counting and the places of a token need only a
few blocks.  The file also lists the documents it holds and where each starts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MAGIC = b"WVLT0001"
_BLOCK = 1 << 13  # bytes of a raw block
_BITS = _BLOCK * 8
_CODEC = pa.Codec("zstd", 1)


def build(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray, bits: int) -> bytes:
    """File of ``ids`` (each below ``2**bits``) and of the documents' ids (``known`` is False for a null id) and starts."""
    n = len(ids)
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    blocks_of = -(-n // _BITS)
    zeros, ones_before, sizes, body = [], [], [], []
    for level in range(bits):
        bit = (cur >> (bits - 1 - level) & 1).astype(bool)
        packed = np.packbits(bit)
        before = np.zeros(blocks_of, np.int64)
        ones = 0
        for b in range(blocks_of):
            before[b] = ones
            raw = packed[b * _BLOCK : (b + 1) * _BLOCK]
            ones += int(np.bitwise_count(raw).sum())
            small = _CODEC.compress(raw.tobytes(), asbytes=True)
            keep = small if len(small) < len(raw) else raw.tobytes()
            sizes.append(len(keep))
            body.append(keep)
        zeros.append(n - ones)
        ones_before.append(before)
        cur = np.concatenate([cur[~bit], cur[bit]])
    head = np.array([n, bits, len(doc_ids)], np.int64)
    parts = [_MAGIC, head.tobytes(), np.array(zeros, np.int64).tobytes(), np.concatenate([*ones_before, np.empty(0, np.int64)]).tobytes()]
    parts += [np.array(sizes, np.int64).tobytes(), doc_ids.astype(np.int64).tobytes(), known.astype(np.uint8).tobytes(), starts.astype(np.int64).tobytes()]
    return b"".join(parts + body)


class WaveletMatrix:
    """Reads a file made by ``build`` (any bytes-like object, for example a memory map)."""

    def __init__(self, content):
        raw = np.frombuffer(content, np.uint8) if not isinstance(content, np.ndarray) else content
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError("not a wavelet file")
        at = 8

        def take(count, kind=np.int64):
            nonlocal at
            size = int(count) * np.dtype(kind).itemsize
            out = np.frombuffer(raw[at : at + size].tobytes(), kind)
            at += size
            return out

        self.n, self.bits, docs = map(int, take(3))
        self.zeros = take(self.bits)
        self.blocks = -(-self.n // _BITS)
        self._before = take(self.bits * self.blocks).reshape(self.bits, self.blocks)
        self._sizes = take(self.bits * self.blocks)
        self.doc_ids, self.known, self.starts = take(docs), take(docs, np.uint8).astype(bool), take(docs)
        self._offset = at + np.cumsum(self._sizes) - self._sizes
        self._raw = raw
        self._kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, level: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block and the ones before each of them."""
        if (level, b) not in self._kept:
            k = level * self.blocks + b
            size = min(_BLOCK, -(-self.n // 8) - b * _BLOCK)
            x = self._raw[int(self._offset[k]) : int(self._offset[k] + self._sizes[k])].tobytes()
            if len(x) < size:
                x = _CODEC.decompress(x, decompressed_size=size, asbytes=True)
            bit = np.unpackbits(np.frombuffer(x, np.uint8))
            if len(self._kept) > 256:
                self._kept.clear()
            self._kept[level, b] = bit, np.cumsum(bit, dtype=np.int64) - bit
        return self._kept[level, b]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i <= 0:
            return 0
        if i >= self.n:
            return self.n - int(self.zeros[level])
        bit, before = self._block(level, i // _BITS)
        return int(self._before[level, i // _BITS] + before[i % _BITS])

    def __len__(self) -> int:
        return self.n

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit = int(self._block(level, i // _BITS)[0][i % _BITS])
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _down(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in ``[lo, hi)``."""
        hi = self.n if hi is None else min(hi, self.n)
        if not 0 <= token < 1 << self.bits or lo >= hi:
            return 0
        a, b = self._down(token, max(lo, 0), hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position ``i``."""
        return self.count(token, 0, i)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) zero or one of a plane."""
        before = self._before[level]
        have = before if bit else np.arange(self.blocks) * _BITS - before
        b = int(np.searchsorted(have, k, side="right")) - 1
        return b * _BITS + int(np.flatnonzero(self._block(level, b)[0] == bit)[k - int(have[b])])

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of a token."""
        if not 0 <= token < 1 << self.bits:
            raise IndexError(k)
        lo, hi = self._down(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, one, i - int(self.zeros[level]) if one else i)
        return i

    def positions(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids: the partitions undone from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            packed = []
            for b in range(self.blocks):
                k = level * self.blocks + b
                size = min(_BLOCK, -(-self.n // 8) - b * _BLOCK)
                x = self._raw[int(self._offset[k]) : int(self._offset[k] + self._sizes[k])].tobytes()
                packed.append(x if len(x) == size else _CODEC.decompress(x, decompressed_size=size, asbytes=True))
            bit = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8), count=self.n).astype(bool)
            z = int(self.zeros[level])
            below, out = out, np.empty_like(out)
            out[~bit] = below[:z]
            out[bit] = below[z:] | out.dtype.type(1 << (self.bits - 1 - level))
        return out

    def document(self, k: int) -> list[int]:
        """Ids of the ``k``-th document of the file, by access."""
        end = int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.n
        return [self.access(i) for i in range(int(self.starts[k]), end)]
