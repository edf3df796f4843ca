"""Carry values down an ordered table without one window per key.

A key's rows are cut into blocks of the order column.  Each block is summed up in one row (its last value, its count),
a window over those few rows carries them to the next blocks, and a window inside each block does the rest, so a key
with most of the rows is worked on by as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024  # order values per block; shapes the tasks only


def carry_down(df: DataFrame, keys: list[str], order: str, values: dict[str, Column] | None = None,
               counts: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds per row and key: for each of ``values`` the last one that is not NULL at or before the row, for each of
    ``counts`` the number of rows at or before it for which the condition holds."""
    values, counts = values or {}, counts or {}
    d = df.withColumn("_b", F.floor(F.col(order) / block))
    for name, v in values.items():
        d = d.withColumn("_v_" + name, v)
    for name, c in counts.items():
        d = d.withColumn("_c_" + name, F.when(c, 1).otherwise(0))
    at = lambda name: F.when(F.col("_v_" + name).isNotNull(), F.col(order))
    per = d.groupBy(*keys, "_b").agg(
        *[F.max_by("_v_" + n, at(n)).alias(n) for n in values], *[F.sum("_c_" + n).alias(n) for n in counts])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *[F.col(k).alias("_k_" + k) for k in keys], F.col("_b").alias("_pb"),
        *[F.last(n, ignorenulls=True).over(before).alias("_p_" + n) for n in values],
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_p_" + n) for n in counts])
    on = F.col("_b") == F.col("_pb")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("_k_" + k))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(per, on).select(
        *df.columns,
        *[F.coalesce(F.last("_v_" + n, ignorenulls=True).over(inside), F.col("_p_" + n)).alias(n) for n in values],
        *[(F.sum("_c_" + n).over(inside) + F.col("_p_" + n)).alias(n) for n in counts])
