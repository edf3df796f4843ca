"""Carry decisions about rows (by id and text) back to the full rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickpulse.llm.key_filter import build_filter, holds

_KEY = ("none", "id", "raw")


def text_hash(text_col: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def screened(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``texts`` (``doc_id, text``) that ``marks`` (``doc_id, raw``) name, and by chance a few others: what is shuffled
    to fetch texts grows with the texts asked for, not with the table."""
    wanted = build_filter(marks.select(F.xxhash64("doc_id", "raw").alias("key")))

    def screen(batches):
        for b in batches:
            yield b.filter(pa.array(holds(wanted.value, b.column("key").to_numpy().view(np.uint64)))).select(["doc_id", "text"])

    return texts.select("doc_id", "text", F.xxhash64("doc_id", text_hash("text")).alias("key")).mapInArrow(screen, "doc_id long, text string")


def private_prefix(taken: list[str]) -> str:
    """A prefix that no column name starts with, in any case."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; what holds a map at any depth is hashed as its JSON text."""
    of = lambda c, t: F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if "map<" in t else F.col(f"`{c}`")
    return F.xxhash64(*[of(c, t) for c, t in docs.dtypes])


def chosen_rows(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: str | None = None, carry: tuple[str, ...] = (), always_shuffle: bool = True) -> DataFrame:
    """One full row of ``docs`` for each distinct ``doc_id, raw`` of ``marks``, or as many as its ``copies`` column says.

    All columns are returned as they are, whatever their names and types, and the ``carry`` columns of ``marks``.  Of rows that
    repeat id and text the first by a hash of all columns is taken.  The join shuffles both sides, so a table of any size takes
    the same plan; without ``always_shuffle`` Spark may send round ``marks`` that it measured as small.
    """
    p = private_prefix(docs.columns)
    key = [p + c for c in _KEY]
    of = lambda c: (F.col(f"`{c}`").isNull().alias(key[0]), F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(key[1]))
    left = docs.select("*", *of(id_col), text_hash(f"`{text_col}`").alias(key[2]))
    extra = [F.col(copies).cast("long").alias(p + "copies")] if copies else []
    right = marks.select(*of("doc_id"), F.col("raw").alias(key[2]), *extra, *[F.col(c).alias(f"{p}carry_{c}") for c in carry])
    both = left.join(right.hint("merge") if always_shuffle else right, key)
    first = both.withColumn(p + "n", F.row_number().over(Window.partitionBy(*key).orderBy(_row_hash(docs)))).where(F.col(p + "n") == 1)
    if copies:
        # in two steps, so that no array holds more than a million entries
        million = F.lit(1_000_000).cast("long")
        many = F.col(p + "copies")
        first = first.where(many > 0).withColumn(p + "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((many - 1) / million))))
        first = first.withColumn(p + "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(million, many - F.col(p + "block") * million))))
    return first.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{p}carry_{c}").alias(c) for c in carry])
