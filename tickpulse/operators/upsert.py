"""Table-write semantics as pure DataFrame functions (inventory 2.2).

``upsert`` returns the content of the target table after the write;
``tickpulse.tables.bucket_table`` writes and commits the same merges.  Rows whose key has a NULL never
conflict, as with SQL unique constraints.  Keys travel as two 64-bit hashes, so a long
text in a key is neither a shuffle nor a sort key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_key(keys: list[str]) -> Column:
    """True for a key that never conflicts: one with a NULL in it."""
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.col(k).isNull()
    return cond


def key_hashes(keys: list[str], columns: list[str], k1: str = "_k1", k2: str = "_k2") -> list[Column]:
    """Two hashes that stand for the key.  A key with a NULL has no second hash (it joins nothing) and a first one that spreads its rows."""
    nothing = null_key(keys)
    text = [F.col(c).cast("string") for c in columns]
    return [
        F.when(nothing, F.xxhash64(*text)).otherwise(F.xxhash64(*keys)).alias(k1),
        F.when(~nothing, F.xxhash64(F.lit("second"), *keys)).alias(k2),
    ]


def dedup_batch(df: DataFrame, keys: list[str], order: list, keep: str = "first", null_apart: str | None = None) -> DataFrame:
    """One row per key inside a batch: the first (or last) by ``order``; rows with a NULL key are all kept.

    Rows of one key are reduced in every task before the shuffle, so a key may be repeated any number of times.  ``null_apart``
    names the column whose NULL marks a key that never conflicts; as given any NULL among the keys does.
    """
    apart = F.col(null_apart).isNull() if null_apart else null_key(keys)
    named = [c if isinstance(c, Column) else F.col(c) for c in order]
    rows = df.where(~apart).select(*df.columns, *key_hashes(keys, keys, "_h1", "_h2"), F.struct(*named).alias("_o"))
    best = F.min_by if keep == "first" else F.max_by
    one = rows.groupBy("_h1", "_h2").agg(best(F.struct(*df.columns), "_o").alias("_row")).select("_row.*")
    return one.unionByName(df.where(apart))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], mode: str = "update",
           order: list | None = None) -> DataFrame:
    """Merge ``incoming`` into ``existing`` on ``keys``.

    mode='update': incoming rows replace existing ones (last incoming row per key wins);
    mode='ignore': existing rows stay, new keys are inserted (first incoming row per key wins).
    ``order`` is the batch order of ``incoming`` (a total order makes the result deterministic).
    """
    if mode not in ("update", "ignore"):
        raise ValueError(f"unknown upsert mode {mode!r}")
    cols = existing.columns
    hashed = key_hashes(keys, keys)
    same = [F.col(c).cast(t) for c, t in existing.dtypes]  # equal values of two types hash apart
    inc = dedup_batch(incoming.select(*same), keys, order or keys, keep="first" if mode == "ignore" else "last")
    inc, old = inc.select("*", *hashed), existing.select("*", *hashed)
    of = lambda df: df.select("_k1", "_k2").where("_k2 is not null")
    if mode == "ignore":
        return existing.unionByName(inc.join(of(old), ["_k1", "_k2"], "left_anti").select(*cols))
    return old.join(of(inc), ["_k1", "_k2"], "left_anti").select(*cols).unionByName(inc.select(*cols))


def insert_unique(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list) -> DataFrame:
    """sink_insert_unique: append, skipping rows whose key is already present (in table or batch)."""
    return upsert(existing, incoming, keys, "ignore", order)


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """sink_replace_by_key: delete every row of each incoming key, then insert the incoming rows."""
    keys = incoming.select(key).where(F.col(key).isNotNull()).distinct()
    return existing.join(keys, key, "left_anti").unionByName(incoming.select(*existing.columns))


def upsert_ranks(existing: DataFrame, incoming: DataFrame, keys: list[str], interval: str = "interval", replace_interval: bool = False) -> DataFrame:
    """sink_top_upsert / sink_trending_upsert: incoming ranks replace those of the same key.

    A list that got shorter leaves the old list's further ranks behind, as in the reference; ``replace_interval`` deletes the whole
    old list of every incoming interval first (SURVEY Q16)."""
    return replace_by_key(existing, incoming, interval) if replace_interval else upsert(existing, incoming, keys, "update")


def append(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Plain append (bulk insert)."""
    return existing.unionByName(incoming.select(*existing.columns))
