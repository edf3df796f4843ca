"""A Bloom filter over 64-bit keys, built slice by slice in tasks and of bounded size however many keys there are.

Keys are dealt by their upper bits, so every slice of the bit table is made in one place and holds only its own keys;
the driver only lines up the finished slices.  With more keys than the largest table serves well the filter lets
more foreign keys pass and never loses one of its own, so callers stay right at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLICES = 64  # a power of two
_MIN_BITS, _MAX_BITS = 1 << 15, 1 << 27  # 4 KB to 16 MB


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers for each key, both inside the slice that its upper six bits name."""
    inner = np.uint64(bits // _SLICES - 1)
    base = (keys >> np.uint64(58)) * np.uint64(bits // _SLICES)
    return base + (keys & inner), base + ((keys >> np.uint64(27)) & inner)


def _one(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for every key that went into the table, and by chance for a few others."""
    a, b = _places(keys, len(table) * 8)
    return (_one(table, a) & _one(table, b)).view(bool)


def build_filter(keys: DataFrame, key: str = "key") -> Broadcast:
    """The bit table over the ``key`` column (long, no nulls) as a broadcast ``uint8`` array; 16 bits for each key up to 16 MB."""
    count = keys.count()
    bits = _MIN_BITS
    while bits < min(_MAX_BITS, 16 * count):
        bits *= 2

    def gather(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            k = b.column(0).to_numpy().view(np.uint64)
            part = (k >> np.uint64(58)).astype(np.int64)
            for s in np.unique(part).tolist():
                slot = made.setdefault(s, np.zeros(bits // _SLICES, bool))
                for at in _places(k[part == s], bits):
                    slot[(at - np.uint64(s * (bits // _SLICES))).astype(np.int64)] = True
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(made), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in made.values()], pa.binary())], names=["slice", "bits"]
            )

    dealt = keys.select(key).repartition(8, F.shiftrightunsigned(key, 58))
    table = np.zeros(bits // 8, np.uint8)
    size = bits // _SLICES // 8
    for row in dealt.mapInArrow(gather, "slice long, bits binary").toLocalIterator():
        table[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)
