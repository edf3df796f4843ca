"""Training data preparation, splits, the text classifier and its evaluation
(inventory 2.5 evaluation aggregates, flows 2.11 training group).

Neural fine-tuning is re-aimed to a Spark ML pipeline (RegexTokenizer ->
HashingTF -> IDF -> LogisticRegression) trained on the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickpulse.constants import CLASS_LABELS, NEGATIVE, NEUTRAL, POSITIVE


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- preparation
def export_columns(df: DataFrame, cols: list[str], defaults: dict | None = None) -> DataFrame:
    """prj_default_fill / sink_table_export: fixed column list; absent columns become NULL,
    then per-column defaults fill NULLs."""
    defaults = defaults or {}
    out = []
    for c in cols:
        v = F.col(c) if c in df.columns else F.lit(None).cast("string")
        if c in defaults:
            v = F.coalesce(v, F.lit(defaults[c]))
        out.append(v.alias(c))
    return df.select(*out)


def normalise_labelled(df: DataFrame) -> DataFrame:
    """flow_prepare_training: the four normalised fields with their defaults."""
    return export_columns(df, ["text", "label", "stock_code", "has_stock"],
                          {"text": "", "label": "neutral", "stock_code": "", "has_stock": False}) \
        .withColumn("has_stock", F.col("has_stock").cast("boolean"))


def stock_tag(text, code) -> Column:
    """fn_stock_tag: '[STOCK]code[/STOCK] text' when a code is present ('' means none)."""
    c = _c(code)
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit("[STOCK]"), c, F.lit("[/STOCK] "), _c(text))) \
        .otherwise(_c(text))


def split_by_stock(df: DataFrame, min_confidence: float | None = None, include_no_stock: bool = True) -> DataFrame:
    """flow_split_by_stock: confidence filter, optional has-stock filter, a ``part`` column
    ('with_stock' / 'without_stock') to write with ``partitionBy('part')``."""
    out = df
    if min_confidence is not None and "confidence" in df.columns:
        out = out.where(F.col("confidence") >= min_confidence)
    if not include_no_stock:
        out = out.where(F.col("has_stock"))
    return out.withColumn("part", F.when(F.col("has_stock"), F.lit("with_stock")).otherwise(F.lit("without_stock")))


def write_by_stock(df: DataFrame, path: str, min_confidence: float | None = None, include_no_stock: bool = True) -> None:
    """flow_split_by_stock as outputs: ``part=with_stock`` and ``part=without_stock`` below ``path``.  Dynamic partition overwrite:
    a run replaces the parts it has rows for and leaves the other as it was."""
    out = split_by_stock(df, min_confidence, include_no_stock)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _spread(key: Column, seed: int) -> Column:
    """Multiplicative hash of an integer key; the key is first reduced so that the product never overflows."""
    reduced = F.pmod(F.pmod(key, F.lit(1 << 31)) + F.lit(seed), F.lit(1 << 31))
    return F.pmod(reduced * F.lit(2654435761), F.lit(4294967296))


def hash_split(df: DataFrame, key: str, train_pct: int = 80, seed: int = 42) -> DataFrame:
    """flow_train_test_split: a stable 80/20 split by a multiplicative hash of an integer key
    (or xxhash64 of any other key), seeded."""
    k = F.col(key)
    if dict(df.dtypes)[key] in ("int", "bigint", "smallint", "tinyint"):
        bucket = _spread(k, seed) % 100
    else:
        bucket = F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(100))
    return df.withColumn("split", F.when(bucket < train_pct, F.lit("train")).otherwise(F.lit("test")))


def with_line_numbers(df: DataFrame, order: list[str], col: str = "line_no") -> DataFrame:
    """Dense 0-based line numbers in ``order``: a range-partitioned sort written once with each row's place
    in its partition, then the row counts of the partitions before (one row per partition)."""
    from tickpulse.session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, "lines")
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at") % (1 << 33))
    counts = rows.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.join(counts, F.col("_part") == F.col("_p")).withColumn(col, F.col("_before") + F.col("_row"))
    return out.select(*df.columns, col)


def ordered_split(df: DataFrame, order: list[str] | None = None, train_fraction: float = 0.9) -> DataFrame:
    """flow_ordered_split: first floor(0.9 n) rows by line order -> train, the rest -> test, at any size.

    Without ``order`` the rows carry their ``line_no`` already (``sources.unified.numbered_lines``)."""
    numbered = with_line_numbers(df, order) if order else df
    n = df.agg(F.count(F.lit(1))).scalar()
    cut = F.floor(n * F.lit(train_fraction))
    return numbered.withColumn("split", F.when(F.col("line_no") < cut, F.lit("train")).otherwise(F.lit("test")))


def sample_rows(df: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """sample_n: a deterministic pseudo-random sample of n rows (all rows if fewer)."""
    k = F.col(key)
    return df.orderBy(_spread(k, seed), k).limit(n)


# ---------------------------------------------------------------- distributions
def label_distribution(df: DataFrame) -> DataFrame:
    """agg_label_distribution: counts per label, per has_stock, and overall, in one cube pass."""
    return df.cube("label", "has_stock").agg(F.count(F.lit(1)).alias("n"))


def confidence_histogram(df: DataFrame, col: str = "confidence") -> DataFrame:
    """agg_confidence_histogram: seven buckets with share of the total, plus min / max / avg."""
    c = F.col(col)
    bucket = (F.when(c == 1.0, F.lit("1.0")).when(c >= 0.9, F.lit("0.9-1.0")).when(c >= 0.8, F.lit("0.8-0.9"))
              .when(c >= 0.7, F.lit("0.7-0.8")).when(c >= 0.6, F.lit("0.6-0.7")).when(c >= 0.5, F.lit("0.5-0.6"))
              .otherwise(F.lit("<0.5")))
    per = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"),
                                                 F.sum(c).alias("s"), F.count(c).alias("k"))
    every = Window.partitionBy()  # over at most seven rows
    return per.select("bucket", "n", (F.col("n") / F.sum("n").over(every) * F.lit(100.0)).alias("pct"),
                      F.min("lo").over(every).alias("min_confidence"), F.max("hi").over(every).alias("max_confidence"),
                      (F.sum("s").over(every) / F.sum("k").over(every)).alias("avg_confidence"))


def symbol_sentiment_matrix(df: DataFrame) -> DataFrame:
    """agg_symbol_sentiment_matrix: sentiment counts per symbol (the NULL symbol row is the
    no-symbol total)."""
    s = F.col("sentiment")
    return df.groupBy("symbol").agg(
        F.count(F.when(s == POSITIVE, 1)).alias("positive"),
        F.count(F.when(s == NEGATIVE, 1)).alias("negative"),
        F.count(F.when(s == NEUTRAL, 1)).alias("neutral"),
        F.count(F.lit(1)).alias("total"),
    )


def exact_quantiles(df: DataFrame, by: str, col: str, qs: list[float], slots: int = 256) -> DataFrame:
    """``by, q, value``: quantiles with linear interpolation, exact and in bounded memory.

    Rank refinement: for each group and each of the two order statistics a quantile lies between, a bracket of values is
    cut into ``slots`` equal pieces, the rows in each are counted (with the smallest and largest value there), and the piece
    that holds the rank becomes the next bracket, until it holds one value.  Every pass is one partial aggregation of at most
    ``slots`` rows per group and rank, whatever the number of distinct values.  NULL and NaN take no part.
    """
    from tickpulse.session import scratch_path

    spark = df.sparkSession
    rows = df.select(F.col(by).alias("_g"), F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))

    def written(state: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        state.write.parquet(path)
        return spark.read.parquet(path)

    per = rows.groupBy("_g").agg(F.count("_x").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    at = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    ranks = per.select("_g", "n", "lo", "hi", at).withColumn("place", F.col("q") * (F.col("n") - 1))
    rank = F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")
    brackets = written(ranks.select(F.col("_g").alias("g"), "q", "place", "lo", "hi", F.lit(0).cast("long").alias("below"), rank), "brackets")
    while not brackets.where("lo < hi").isEmpty():
        # ranks of one group often share a bracket; it is counted once
        open_ = brackets.where("lo < hi").select("g", "lo", "hi").distinct()
        inside = rows.join(open_, F.col("_g").eqNullSafe(F.col("g")) & F.col("_x").between(F.col("lo"), F.col("hi")))
        share = F.nanvl((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.5))  # infinite ends
        slot = F.when(F.col("_x") == F.col("lo"), 0).when(F.col("_x") == F.col("hi"), slots - 1).otherwise(F.least(F.lit(slots - 2), F.greatest(F.lit(1), F.floor(share * slots).cast("int"))))
        count = inside.groupBy("g", "lo", "hi", slot.alias("slot")).agg(F.count("*").alias("k"), F.min("_x").alias("from"), F.max("_x").alias("to"))
        before = Window.partitionBy("g", "lo", "hi").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # over the slots
        count = count.select(F.col("g").alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "k", "from", "to", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("less"))
        same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
        inner = F.col("rank") - F.col("below")
        step = brackets.where("lo < hi").join(count, same).where((inner >= F.col("less")) & (inner < F.col("less") + F.col("k")))
        step = step.select("g", "q", "place", F.col("from").alias("lo"), F.col("to").alias("hi"), (F.col("below") + F.col("less")).alias("below"), "rank")
        brackets = written(step.unionByName(brackets.where("lo = hi")), "brackets")
    ends = brackets.groupBy("g", "q", "place").agg(F.min("lo").alias("a"), F.max("lo").alias("b"))
    part = F.col("place") - F.floor("place")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part)
    return ends.select(F.col("g").alias(by), "q", value.alias("value"))


def confidence_describe(df: DataFrame, by: str = "true_label", col: str = "confidence") -> DataFrame:
    """agg_confidence_describe: count, mean, std, min, 25/50/75 % (linear interpolation), max."""
    c = F.col(col)
    plain = df.groupBy(by).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    at = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    wide = exact_quantiles(df, by, col, list(at)).groupBy(F.col(by).alias("_g")).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in at.items()])
    return plain.join(wide, F.col(by).eqNullSafe(F.col("_g")), "left").select(by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def confusion_matrix(df: DataFrame, labels: list[str] = CLASS_LABELS, true_col="true_label",
                     pred_col="pred_label") -> DataFrame:
    """agg_confusion_matrix: dense true x pred counts over the given labels (missing cells = 0)."""
    spark = df.sparkSession
    arr = F.array(*[F.lit(x) for x in labels])
    grid = spark.range(1).select(F.explode(arr).alias("true_label")).select(
        "true_label", F.explode(arr).alias("pred_label"))
    counts = df.groupBy(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["true_label", "pred_label"], "left").select(
        "true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _class_table(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """One row: the true x predicted counts (classes squared cells at most) and the ratios per class, from one pass."""
    cells = df.groupBy(F.col(true_col).alias("t"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    one = cells.agg(F.collect_list(F.struct("t", "p", "n")).alias("cells"))
    zero = F.lit(0).cast("bigint")

    def total(cond):
        return F.aggregate(F.filter("cells", cond), zero, lambda a, c: a + c["n"])

    def ratio(x, y):
        return F.when(y > 0, x / y).otherwise(F.lit(0.0))

    names = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.array(c["t"], c["p"]))))
    names = F.filter(names, lambda x: x.isNotNull())
    one = one.withColumn("counts", F.transform(names, lambda x: F.struct(
        x.alias("label"), total(lambda c: c["t"] == x).alias("support"), total(lambda c: c["p"] == x).alias("predicted"),
        total(lambda c: (c["t"] == x) & (c["p"] == x)).alias("tp"))))
    one = one.withColumn("ratios", F.transform("counts", lambda c: F.struct(
        c["label"].alias("label"), ratio(c["tp"], c["predicted"]).alias("precision"), ratio(c["tp"], c["support"]).alias("recall"),
        c["support"].alias("support"))))
    one = one.withColumn("classes", F.transform("ratios", lambda r: F.struct(
        r["label"].alias("label"), r["precision"].alias("precision"), r["recall"].alias("recall"),
        ratio(2 * r["precision"] * r["recall"], r["precision"] + r["recall"]).alias("f1_score"), r["support"].alias("support"))))
    return one.withColumn("right", total(lambda c: c["t"] == c["p"])).withColumn("rows", total(lambda c: F.lit(True)))


def _mean(field: str, weighted: bool) -> Column:
    add = (lambda a, c: a + c[field] * c["support"]) if weighted else (lambda a, c: a + c[field])
    by = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, c: a + c["support"]) if weighted else F.size("classes")
    return F.when(by > 0, F.aggregate("classes", F.lit(0.0), add) / by)


def classification_report(df: DataFrame, true_col="true_label", pred_col="pred_label") -> DataFrame:
    """agg_classification_report: per-class precision / recall / F1 / support, accuracy,
    macro and weighted averages (undefined ratios -> 0); the input is evaluated once."""
    one = _class_table(df, true_col, pred_col)
    support = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, c: a + c["support"])

    def row(name, *values):
        fields = ("precision", "recall", "f1_score", "support")
        return F.struct(F.lit(name).alias("label"), *[v.alias(f) for v, f in zip(values, fields)])

    none = F.lit(None).cast("double")
    extra = F.array(
        row("accuracy", none, none, F.when(F.col("rows") > 0, F.col("right") / F.col("rows")), F.col("rows")),
        row("macro avg", *[_mean(f, False) for f in ("precision", "recall", "f1_score")], support),
        row("weighted avg", *[_mean(f, True) for f in ("precision", "recall", "f1_score")], support))
    return one.select(F.explode(F.concat("classes", extra)).alias("c")).select("c.*")


def weighted_metrics(df: DataFrame, true_col="true_label", pred_col="pred_label") -> DataFrame:
    """agg_weighted_metrics: accuracy and support-weighted precision / recall / F1 from one pass."""
    one = _class_table(df, true_col, pred_col)
    return one.select(F.when(F.col("rows") > 0, F.col("right") / F.col("rows")).alias("accuracy"), _mean("precision", True).alias("precision"),
                      _mean("recall", True).alias("recall"), _mean("f1_score", True).alias("f1"))


# ---------------------------------------------------------------- classifier
def classifier_pipeline(text_col: str = "model_text", label_col: str = "label_idx", num_features: int = 1 << 16,
                        reg_param: float = 0.01):
    """flow_train_classifier (re-aimed): a Spark ML text classifier."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    tok = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[\p{L}\p{N}_\[\]/]+", gaps=False,
                         toLowercase=True)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=30, regParam=reg_param,
                            family="multinomial")
    return Pipeline(stages=[tok, tf, idf, lr])


def label_index(col="label") -> Column:
    """negative -> 0, neutral -> 1, positive -> 2 (other -> neutral)."""
    c = F.col(col)
    return F.when(c == "negative", 0.0).when(c == "positive", 2.0).otherwise(1.0)


def train_classifier(labelled: DataFrame, include_stock_info: bool = True, reg_params=(0.01, 0.1), key: str = "doc_id"):
    """flow_train_classifier: fit one model per candidate on three quarters of the train split, keep the candidate with
    the best weighted F1 on the last quarter, and fit it on the whole train split."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from tickpulse.session import scratch_path

    data = labelled.withColumn("model_text", stock_tag("text", "stock_code") if include_stock_info else F.col("text")) \
        .withColumn("label_idx", label_index())
    train = data.where(F.col("split") == "train")
    tok, tf, idf, _ = classifier_pipeline().getStages()
    part = F.pmod(F.xxhash64(key), F.lit(4)) if key in train.columns else F.lit(None).cast("long")
    spark, path = labelled.sparkSession, scratch_path(labelled.sparkSession, "features")
    # every pass of every fit reads the word counts: the texts are joined, cut and hashed once
    tf.transform(tok.transform(train.withColumn("_part", part))).select("_part", "label_idx", "_tf").write.parquet(path)
    # a step of the fit sends one dense gradient for each task, so there are as many tasks as cores, whatever the rows
    rows = spark.read.parquet(path).coalesce(spark.sparkContext.defaultParallelism)

    def fitted(on: DataFrame, params) -> list:
        weights = idf.fit(on)
        found = weights.transform(on)
        return [PipelineModel([tok, tf, weights, classifier_pipeline(reg_param=r).getStages()[-1].fit(found)]) for r in params]

    best = reg_params[0]
    if len(reg_params) > 1 and key in train.columns:
        check_rows = rows.where("_part = 0")
        judge = MulticlassClassificationEvaluator(labelCol="label_idx", metricName="f1")
        scores = [judge.evaluate(PipelineModel(m.stages[2:]).transform(check_rows)) for m in fitted(rows.where("_part > 0"), reg_params)]
        best = reg_params[scores.index(max(scores))]
    return fitted(rows, [best])[0]


def evaluate_classifier(model, rows: DataFrame, include_stock_info: bool = True) -> DataFrame:
    """flow_evaluate_classifier: (true_label, pred_label, confidence) for every row."""
    from pyspark.ml.functions import vector_to_array

    data = rows.withColumn("model_text", stock_tag("text", "stock_code") if include_stock_info else F.col("text")) \
        .withColumn("label_idx", label_index())
    out = model.transform(data)
    names = F.array(*[F.lit(x) for x in CLASS_LABELS])
    return out.select(
        *[c for c in rows.columns if c in ("doc_id", "split")],
        F.col("label").alias("true_label"),
        F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("pred_label"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def softmax_argmax(df: DataFrame, logits_col: str) -> DataFrame:
    """fn_argmax_softmax: softmax of a logits array, its argmax (0-based) and the top probability."""
    lg = F.transform(F.col(logits_col), lambda x: x.cast("double"))
    m = F.array_max(lg)
    ex = F.transform(lg, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    p = F.transform(ex, lambda x: x / total)
    return df.withColumn("probs", p).withColumn("confidence", F.array_max("probs")) \
        .withColumn("pred", (F.array_position("probs", F.col("confidence")) - 1).cast("bigint"))
