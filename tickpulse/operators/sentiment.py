"""Sentiment scoring with pluggable scorers (flow_sentiment_score).

The gates, the text cleaning and the label mapping are Column expressions;
only the scorer itself may be Python.  A scorer turns a DataFrame with a
cleaned-text column into raw ``_label`` / ``_score`` columns:

* ``FallbackScorer`` -- no model loaded: neutral with confidence 0.5;
* ``ColumnScorer``   -- any Column expression returning struct(label, score);
* ``PandasScorer``   -- a vectorised Python function, run as an Arrow ``pandas_udf``
  (a failing batch is scored again text by text; only the texts that fail are neutral 0.5, marked so);
* ``LoadedScorer``   -- the same for a model that each worker loads once, when its first batch arrives;
* ``MLScorer``       -- a fitted Spark ML ``PipelineModel`` (see ``operators.training``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickpulse.constants import (DEFAULT_CONFIDENCE, EN_TO_VI_LABEL_MAP, MODEL_LABEL_MAP, NEUTRAL,
                                 NEUTRAL_EN)
from tickpulse.functions.text import nfc, sentiment_clean, stripped_length


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def map_label(col, mapping: dict, default: str | None) -> Column:
    """prj_case_label: look a label up in a fixed map; unknown -> ``default``."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    found = F.try_element_at(m, _c(col))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def canonical_label(raw) -> Column:
    """Raw model label -> English -> Vietnamese canonical label (unknown -> neutral)."""
    en = F.coalesce(map_label(raw, MODEL_LABEL_MAP, None), _c(raw))
    return map_label(en, EN_TO_VI_LABEL_MAP, NEUTRAL)


class FallbackScorer:
    """The behaviour without a loaded model: every text is neutral at 0.5."""

    source = "Model not loaded"

    def score(self, df: DataFrame, text_col: str) -> DataFrame:
        return df.withColumn("_label", F.lit(NEUTRAL_EN)).withColumn("_score", F.lit(DEFAULT_CONFIDENCE))


class ColumnScorer:
    def __init__(self, fn: Callable[[Column], Column], source: str = "column"):
        self.fn = fn
        self.source = source

    def score(self, df: DataFrame, text_col: str) -> DataFrame:
        r = self.fn(F.col(text_col))
        return df.withColumn("_r", r).withColumn("_label", F.col("_r.label")) \
            .withColumn("_score", F.col("_r.score").cast("double")).drop("_r")


def _scored_batch(fn: Callable[[pd.Series], pd.DataFrame], s: pd.Series) -> pd.DataFrame:
    """``label, score, failed`` of a batch; where the batch fails, text by text, and only the texts that fail are neutral."""
    def whole(part: pd.Series) -> pd.DataFrame:
        out = fn(part)
        return pd.DataFrame({"label": list(out["label"]), "score": [float(x) for x in out["score"]], "failed": False})

    try:
        return whole(s)
    except Exception:  # noqa: BLE001 - find the texts that the scorer cannot take
        parts = []
        for i in range(len(s)):
            try:
                parts.append(whole(s.iloc[i:i + 1]))
            except Exception:  # noqa: BLE001
                parts.append(pd.DataFrame({"label": [NEUTRAL_EN], "score": [DEFAULT_CONFIDENCE], "failed": [True]}))
        return pd.concat(parts, ignore_index=True)


_SCORED = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("failed", T.BooleanType())])


class PandasScorer:
    """``fn(pd.Series[str]) -> pd.DataFrame[label, score]``, run on Arrow batches."""

    def __init__(self, fn: Callable[[pd.Series], pd.DataFrame], source: str = "pandas"):
        self.source = source

        @F.pandas_udf(_SCORED)
        def _udf(s: pd.Series) -> pd.DataFrame:
            return _scored_batch(fn, s)

        self._udf = _udf

    def score(self, df: DataFrame, text_col: str) -> DataFrame:
        return df.withColumn("_r", self._udf(F.col(text_col))).withColumn("_label", F.col("_r.label")) \
            .withColumn("_score", F.col("_r.score")).withColumn("_failed", F.col("_r.failed")).drop("_r")


_LOADED: dict = {}  # what this worker has loaded, by key


def _load_once(key: str, load: Callable):
    """A module-level function: it reaches the worker by name, and so do the models that the worker keeps."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


class LoadedScorer(PandasScorer):
    """A model that is loaded in the worker: ``load() -> fn`` runs when the first batch arrives, and once for all tasks of the worker.

    ``key`` names the saved model (its path and version); ``fn`` takes and returns what a ``PandasScorer``'s function does.
    """

    def __init__(self, load: Callable[[], Callable[[pd.Series], pd.DataFrame]], key: str, source: str = "loaded_model"):
        self.source = source

        def _udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            fn = None
            for s in batches:
                fn = fn or _load_once(key, load)
                yield _scored_batch(fn, s)

        self._udf = F.pandas_udf(_udf, _SCORED)


class MLScorer:
    """A fitted Spark ML pipeline whose output has ``prediction`` and ``probability``."""

    def __init__(self, model, labels: list[str], input_col: str = "text", source: str = "custom_model"):
        self.model = model
        self.labels = labels
        self.input_col = input_col
        self.source = source

    def score(self, df: DataFrame, text_col: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        # the pipeline sees the given text under its own input name, and the row's columns apart from it
        scored = self.model.transform(df.select(F.struct(*df.columns).alias("_row"), F.col(text_col).alias(self.input_col)))
        names = F.array(*[F.lit(x) for x in self.labels])
        label = F.element_at(names, (F.col("prediction") + 1).cast("int"))
        return scored.select("_row.*", label.alias("_label"), F.array_max(vector_to_array("probability")).alias("_score"))


def saved_scorer(path: str, labels: list[str], input_col: str = "text", source: str = "custom_model") -> MLScorer:
    """A scorer of the pipeline that ``PipelineModel.save`` left at ``path`` in the shared folder."""
    from pyspark.ml import PipelineModel

    return MLScorer(PipelineModel.load(path), labels, input_col, source)


def transform_sentiment(df: DataFrame, text_col: str, scorer=None, prefix: str = "", normalized: bool = False) -> DataFrame:
    """Score ``text_col`` into ``sentiment`` (canonical label), ``confidence`` and ``sentiment_source``.

    ``normalized`` says that the text is NFC already, so it is not normalised again.

    Gates: empty or < 3 stripped characters -> neutral 0.5; after cleaning
    < 2 characters -> neutral 0.5; otherwise the scorer's label, mapped.
    """
    scorer = scorer or FallbackScorer()
    t = F.col(text_col)
    clean_col = "_clean"
    d = df.withColumn(clean_col, F.when(t.isNull(), F.lit("")).otherwise(sentiment_clean(t if normalized else nfc(t))))
    d = scorer.score(d, clean_col)
    short_raw = t.isNull() | (t == "") | (stripped_length(t) < 3)
    short_clean = stripped_length(F.col(clean_col)) < 2
    label = (F.when(short_raw | short_clean, F.lit(NEUTRAL)).otherwise(canonical_label(F.col("_label"))))
    conf = F.when(short_raw | short_clean, F.lit(DEFAULT_CONFIDENCE)).otherwise(
        F.coalesce(F.col("_score"), F.lit(DEFAULT_CONFIDENCE)))
    failed = F.col("_failed") if "_failed" in d.columns else F.lit(False)
    src = (F.when(short_raw, F.lit("Text too short")).when(short_clean, F.lit("Text too short after cleaning"))
           .when(failed, F.lit("Scorer failed")).otherwise(F.lit(scorer.source)))
    return d.withColumn(prefix + "sentiment", label).withColumn(prefix + "confidence", conf) \
        .withColumn(prefix + "sentiment_source", src).drop(clean_col, "_label", "_score", "_failed")
