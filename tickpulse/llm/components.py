"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickpulse.llm.scratch import discard, written


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, label`` for every node of an edge table; the label is the smallest node reachable.

    Nulls and loops are ignored.  Each step is written to the shared folder, so lineage stays short, and deleted once the next is.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    e = written(e, "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u > v").distinct(), "large-star")
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = e
        e = written(small.where("u > v").unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "small-star")
        discard(last, large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
