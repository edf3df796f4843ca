"""Sharding by histogram sort: exact byte counts below candidate keys, refined until the splitters fit, then one exchange.

A row's key is 16 bytes in order: the sort value, then a hash of id and text that
tells equal sort values apart.  Each round every partition counts rows and bytes between
the current probes; only the bracket that still holds a splitter's target is
probed again.  When every splitter is within tolerance, or its bracket holds no
further key, all rows go to their part in a single exchange.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickpulse.llm.rows import private_prefix
from tickpulse.llm.scratch import written

_TOP = 1 << 128


def _as_bytes(values: list[int]) -> np.ndarray:
    return np.array([v.to_bytes(16, "big") for v in values], "S16")


def _row_keys(value: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """128-bit big-endian keys: the signed value moved to unsigned order, then the tie hash."""
    both = np.empty((len(value), 2), ">u8")
    both[:, 0] = value.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    both[:, 1] = tie.astype(np.int64).view(np.uint64)
    return np.ascontiguousarray(both).view("S16").ravel()


def _counts(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Rows and bytes with a key below each probe, counted exactly over all partitions."""
    edges = _as_bytes(probes)

    def count(batches):
        rows, size = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, _row_keys(b.column("value").to_numpy(), b.column("tie").to_numpy()), side="right")
            rows += np.bincount(at, minlength=len(rows))
            size += np.bincount(at, weights=b.column("size").to_numpy(), minlength=len(rows)).astype(np.int64)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(rows[full]), pa.array(size[full])], names=["at", "n", "size"])

    got = keys.mapInArrow(count, "at long, n long, size long").groupBy("at").agg(F.sum("n"), F.sum("size")).collect()
    rows, size = np.zeros(len(edges) + 1, object), np.zeros(len(edges) + 1, object)
    for at, n, s in got:
        rows[at], size[at] = n, s
    return list(zip(np.cumsum(rows)[:-1].tolist(), np.cumsum(size)[:-1].tolist()))


def splitters(keys: DataFrame, parts: int, tolerance: float = 0.001, probes: int = 32) -> tuple[list[int], list[int], list[int]]:
    """Keys that cut ``value, tie, size`` rows into ``parts`` ranges of nearly equal ``size``.

    Returns the ``parts - 1`` keys and, per part, the rows and the sizes before it.  ``tolerance`` is relative to the
    size of a part.  The driver holds ``parts * probes`` counts, never rows.
    """
    low, high, total = keys.agg(F.min("value"), F.max("value"), F.sum("size")).first()
    if low is None or parts < 2:
        return [], [0], [0]
    start, stop = (low + (1 << 63)) << 64, (high + 1 + (1 << 63)) << 64
    n_rows = keys.count()
    aims = [total * (i + 1) / parts for i in range(parts - 1)]
    allowed = tolerance * total / parts
    # bracket of each splitter: key, rows and bytes below it, at both ends
    lo, hi = [(start, 0, 0)] * (parts - 1), [(min(stop, _TOP - 1), n_rows, total)] * (parts - 1)
    found: list[tuple[int, int, int] | None] = [None] * (parts - 1)
    while any(f is None for f in found):
        brackets = Counter((lo[i][0], hi[i][0]) for i, f in enumerate(found) if f is None)
        ask = {a + (b - a) * (j + 1) // (probes * k + 1) for (a, b), k in brackets.items() for j in range(probes * k)}
        ask = sorted(ask)
        exact = list(zip(ask, _counts(keys, ask)))
        marks = np.array([s for _, (_, s) in exact], float)
        for i, f in enumerate(found):
            if f is not None:
                continue
            at = int(np.searchsorted(marks, aims[i]))
            for k in (at - 1, at):
                if 0 <= k < len(exact):
                    key, (n, s) = exact[k]
                    if s < aims[i] and key > lo[i][0]:
                        lo[i] = (key, n, s)
                    elif s >= aims[i] and key < hi[i][0]:
                        hi[i] = (key, n, s)
            near = min(lo[i], hi[i], key=lambda x: abs(x[2] - aims[i]))
            # done within tolerance, or when one row (or rows with one key) is all that is left between
            if abs(near[2] - aims[i]) <= allowed or hi[i][0] - lo[i][0] <= 1 or hi[i][1] - lo[i][1] <= 1:
                found[i] = near
    found.sort()
    return [f[0] for f in found], [0, *[f[1] for f in found]], [0, *[f[2] for f in found]]


def part_column(cuts: list[int], value: Column, tie: Column) -> Column:
    """Number of the range that a row's key falls in."""
    edges = _as_bytes(cuts)

    @F.pandas_udf("long")
    def part(v: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _row_keys(v.to_numpy(), t.to_numpy()), side="right"))

    return part(value, tie)


def key_columns(df: DataFrame, id_col: str, text_col: str, by: str | None = None, prefix: str = "_") -> DataFrame:
    """Adds ``_value`` (sort value, nulls first), ``_tie`` and ``_size`` (UTF-8 bytes plus 16), under another prefix if asked."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        df.withColumn(prefix + "value", F.coalesce(F.col(by or id_col).cast("long"), F.lit(-(1 << 63))))
        .withColumn(prefix + "tie", F.xxhash64(F.col(id_col).cast("long"), text))
        .withColumn(prefix + "size", F.octet_length(text).cast("long") + 16)
    )


def shard(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    by: str | None = None,
    tolerance: float = 0.001,
    part_bytes: int = 16 << 20,
    most_parts: int = 20_000,
) -> DataFrame:
    """Every row with its ``shard`` (0 to ``shards - 1``, equal bytes in key order) and gapless ``slot`` in it.

    Keeps the other columns; columns of the input named ``shard`` or ``slot`` (in any case) are replaced.  Shards are cut into
    parts of about ``part_bytes`` (more when there would be over ``most_parts``), so no task holds a whole shard.
    ``by`` names a column of whole numbers to sort by (default: the id); nulls come first, and rows with equal values are ordered by a
    hash of id and text.  Null texts have size 16.  Rows equal in value, id and text stay together, in any order.
    """
    drop = [c for c in docs.columns if c.lower() in ("shard", "slot")]
    own = docs.drop(*[c for c in drop if c not in (id_col, text_col, by)])
    p = private_prefix(docs.columns)
    value, tie, size, part = (p + c for c in ("value", "tie", "size", "part"))
    keyed = key_columns(own, id_col, text_col, by, p)
    keys = written(keyed.select(F.col(value).alias("value"), F.col(tie).alias("tie"), F.col(size).alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = max(1, min(most_parts // shards, -(-total // (part_bytes * shards))))
    cuts, rows_before, _ = splitters(keys, shards * per, tolerance * per)
    parts = len(rows_before)
    first = [rows_before[i - i % per] for i in range(parts)]
    base = F.element_at(F.array(*[F.lit(int(r - f)).cast("long") for r, f in zip(rows_before, first)]), (F.col(part) + 1).cast("int"))
    placed = keyed.withColumn(part, part_column(cuts, F.col(value), F.col(tie)))
    order = Window.partitionBy(part).orderBy(value, F.col(tie) < 0, tie)
    slot = base + F.row_number().over(order) - 1
    placed = placed.withColumn("slot", slot.cast("long")).withColumn("shard", F.floor(F.col(part) / per).cast("int"))
    return placed.drop(value, tie, size, part)
