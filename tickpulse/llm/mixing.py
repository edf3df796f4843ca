"""Mixing sources to target token weights by entropy balancing, in DataFrame operations only.

Among all document rates the mix takes those that stay closest (in relative
entropy) to one copy each while every source reaches its target number of words
and keeps its mean document length.  The dual of this problem is convex with two
multipliers per source, and the optimal rate of a document is the exponential
tilt ``exp(a + b * x)`` of its centred size ``x``.  Newton steps run on a written
histogram (source, size, documents): one aggregation per step gives gradient and
Hessian of all sources at once.  Rates are then rounded to whole copies: the
whole part for every document, the fractions in hash order up to the target.

With these constraints ``b`` is 0 up to rounding: every document of a source gets
the same rate, ``target / source_size``, and nothing is tilted by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickpulse.llm.rows import chosen_rows, text_hash
from tickpulse.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
_BUCKETS = 1 << 14


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, docs, source_size, target`` of a table ``source, size``.

    Sources weigh ``weights`` in turn by code point order, null last, and share the sum of all sizes; no target is above
    ``most`` times its source's size, and what is cut goes to the others by weight.  Written, one row per source.
    """
    per = written(sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")), "sources")
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    # fill up sources in the order in which they reach their limit: the water level where the first stays below it holds for all
    full = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = per.withColumn("weight", weight).withColumn("limit", limit).withColumn("level", level)
    water = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(Window.partitionBy())
    target = F.coalesce(F.least("limit", F.col("weight") * water), F.col("limit"))
    return written(leveled.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0))).select("source", "docs", "source_size", "target"), "targets")


def _same_source(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def balance(sizes: DataFrame, targets: DataFrame, tolerance: float = 1e-10, steps: int = 60) -> DataFrame:
    """``source, mean, a, b``: multipliers of the tilt ``exp(a + b * (size / mean - 1))`` that meets every target.

    Damped Newton steps on the dual until each source's words are within ``tolerance`` of its target, relative to it.
    Sources without words or without a target have null multipliers (rate 0).
    """
    cells = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "size-histogram")
    wanted = (F.col("source_size") > 0) & (F.col("target") > 0)
    mean = F.when(wanted, F.col("source_size") / F.col("docs"))
    state = targets.select("source", "docs", "source_size", "target", mean.alias("mean"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("miss"))
    for step in range(steps + 1):
        c = cells.select(F.col("source").alias("c_source"), "size", "n")
        x = F.col("size") / F.col("mean") - 1
        rate = F.col("n") * F.exp(F.col("a") + F.col("b") * x)
        sums = (
            state.join(c, _same_source("source", "c_source"))
            .withColumn("x", x)
            .withColumn("r", rate)
            .groupBy("source", "docs", "source_size", "target", "mean", "a", "b")
            .agg(F.sum("r").alias("h0"), F.sum(F.col("r") * F.col("x")).alias("h1"), F.sum(F.col("r") * F.col("x") * F.col("x")).alias("h2"))
        )
        # constraints: documents keep the mean length, so their number is target / mean and the sum of r * x is 0
        g0, g1 = F.col("target") / F.col("mean") - F.col("h0"), -F.col("h1")
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        flat = det <= 1e-12 * F.col("h0") * F.col("h0")  # one size only: nothing to tilt
        da = F.when(flat, g0 / F.col("h0")).otherwise((F.col("h2") * g0 - F.col("h1") * g1) / det)
        db = F.when(flat, F.lit(0.0)).otherwise((F.col("h0") * g1 - F.col("h1") * g0) / det)
        damp = F.least(F.lit(1.0), F.lit(1.0) / F.greatest(F.abs(da), F.abs(db), F.lit(1e-300)))
        miss = F.abs((F.col("h0") + F.col("h1")) * F.col("mean") / F.col("target") - 1)
        state = written(
            sums.select(
                "source", "docs", "source_size", "target", "mean", (F.col("a") + damp * da).alias("a"), (F.col("b") + damp * db).alias("b"), miss.alias("miss")
            ),
            "multipliers",
        )
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise ValueError(f"entropy balancing did not converge: off by {worst:g}")
    return state.select("source", "mean", "a", "b")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
) -> DataFrame:
    """Copies of each document in the mix: ``doc_id, raw, source, size, source_size, target, rate, copies, taken``.

    ``raw`` is a hash of the text, ``size`` counts its words (null: 0), ``taken`` is ``copies * size``.  Documents without words get no copies.
    A null source is a source of its own; an empty table gives no rows; other columns are ignored.  The choice of the
    fractions hashes the id, so reruns agree; rows that repeat an id share its place in that order and differ only
    in the last bucket, where any of the equal rows may be the one that is taken.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_hash(text_col).alias("raw"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    base = written(base, "sizes")
    targets = source_targets(base, weights, most)
    tilt = balance(base, targets)
    facts = targets.join(tilt.withColumnRenamed("source", "t_source"), _same_source("source", "t_source"), "left").drop("t_source", "docs")
    facts = written(facts.withColumnRenamed("source", "f_source"), "source-facts")

    raw = F.least(F.lit(float(most)), F.exp(F.col("a") + F.col("b") * (F.col("size") / F.col("mean") - 1)))
    rate = F.when((F.col("size") > 0) & F.col("a").isNotNull(), F.round(raw, 7)).otherwise(F.lit(0.0))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    rated = (
        base.join(facts, _same_source("source", "f_source"))
        .withColumn("rate", rate)
        .drop("f_source", "mean", "a", "b")
        .withColumn("whole", F.floor("rate"))
        .withColumn("part", F.col("rate") - F.col("whole"))
        .withColumn("q", F.when(F.col("part") > 0, place / F.col("part")))
        .withColumn("bucket", F.when(F.col("q").isNotNull(), F.least(F.floor(F.col("q") * _BUCKETS), F.lit(2 * _BUCKETS))))
    )
    # words that the fractions still owe each source, and the bucket of the hash order in which they are reached
    per = rated.groupBy("source", "bucket").agg(
        F.sum(F.when(F.col("bucket").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target")
    )
    per = written(per, "hash-order")
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        per.withColumn("owed", F.col("target") - F.sum("sure").over(Window.partitionBy("source")))
        .withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        .where(F.col("bucket").isNotNull())
        .withColumn("state", F.when(F.col("before") + F.col("words") <= F.col("owed"), 2).when(F.col("before") < F.col("owed"), 1).otherwise(0))
    )
    steps = written(
        steps.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "state", (F.col("owed") - F.col("before")).alias("left_over")).where("state > 0"), "steps"
    )
    # whole buckets end at one bucket per source; only that one needs the order inside it
    last = steps.where("state = 2").groupBy(F.col("s_source").alias("l_source")).agg(F.max("s_bucket").alias("last"))
    last = written(last, "last-bucket")
    edge = written(steps.where("state = 1").select(F.col("s_source").alias("e_source"), F.col("s_bucket").alias("edge"), "left_over"), "edge-bucket")
    placed = rated.join(last, _same_source("source", "l_source"), "left").join(edge, _same_source("source", "e_source"), "left").drop("l_source", "e_source")
    at_edge = F.col("bucket").isNotNull() & F.col("edge").isNotNull() & (F.col("bucket") == F.col("edge"))
    inner = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    final = ["doc_id", "raw", "source", "size", "source_size", "target", "rate"]
    sure = placed.where(~at_edge).select(*final, (F.col("whole") + F.when(F.col("bucket") <= F.col("last"), 1).otherwise(0)).alias("copies"))
    extra = F.when(F.coalesce(F.sum("size").over(inner), F.lit(0)) + F.col("size") / 2 <= F.col("left_over"), 1).otherwise(0)
    edged = placed.where(at_edge).select(*final, (F.col("whole") + extra).alias("copies"))
    return sure.unionByName(edged).withColumn("taken", F.col("copies") * F.col("size"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken; rows with no copies are left out.

    Rows that repeat id and text share their copies.
    """
    marks = mix(docs, id_col, text_col, source_col, **options).where("copies > 0").groupBy("doc_id", "raw").agg(F.sum("copies").alias("copies"))
    return chosen_rows(docs, written(marks, "mix"), id_col, text_col, "copies")
