"""Registered queries: training data, splits, classifier, evaluation metrics and ROUGE."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickpulse.operators import evaluation as ev
from tickpulse.operators import training as trn
from tickpulse.plans import oracle_text as ot
from tickpulse.plans.oracle_fixtures import with_fixtures
from tickpulse.plans.registry import register
from tickpulse.session import scratch_path
from tickpulse.sources import fixtures as fx
from tickpulse.sources.unified import read_pairs_jsonl


def _pred(spark, sf):
    return fx.predictions(spark, sf)


def _r(df, cols, digits=9):
    """Round order-dependent floating results (sums, averages, interpolations) for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("flow_prepare_training", with_fixtures("select text, label, stock_code, has_stock from labelled", "labelled"))
def q_flow_prepare_training(spark, sf):
    return trn.normalise_labelled(fx.labelled(spark, sf).select("text", "label", "stock_code", "has_stock"))


@register("agg_label_distribution", with_fixtures(
    "select label, has_stock, count(*) as n from labelled group by cube(label, has_stock)", "labelled"))
def q_agg_label_distribution(spark, sf):
    return trn.label_distribution(fx.labelled(spark, sf))


_LAB_CONF = """select l.text, l.label, l.stock_code, l.has_stock, p.confidence from labelled l join predictions p on l.doc_id = p.doc_id"""


@register("flow_split_by_stock", with_fixtures(
    "select *, case when has_stock then 'with_stock' else 'without_stock' end as part from lc where confidence >= 0.5",
    "labelled", "predictions", extra=[("lc", _LAB_CONF)]))
def q_flow_split_by_stock(spark, sf):
    lc = fx.labelled(spark, sf).join(_pred(spark, sf).select("doc_id", "confidence"), "doc_id") \
        .select("text", "label", "stock_code", "has_stock", "confidence")
    path = scratch_path(spark, "by-stock")
    trn.write_by_stock(lc, path, min_confidence=0.5)
    return spark.read.parquet(path)


@register("flow_train_test_split", with_fixtures(
    """select doc_id, label, case when (((doc_id % 2147483648 + 42) % 2147483648) * 2654435761) % 4294967296 % 100 < 80 then 'train' else 'test' end
        as split from labelled""", "labelled"))
def q_flow_train_test_split(spark, sf):
    return trn.hash_split(fx.labelled(spark, sf), "doc_id").select("doc_id", "label", "split")


@register("flow_ordered_split", with_fixtures(
    """select pair_id, row_number() over (order by pair_id) - 1 as line_no,
        case when row_number() over (order by pair_id) - 1 < floor((select count(*) from rewrite_pairs) * 0.9) then 'train'
             else 'test' end as split from rewrite_pairs""", "rewrite_pairs"))
def q_flow_ordered_split(spark, sf):
    """The pairs as JSON lines in several files, in the order of their ids; the split follows the lines of the files."""
    path = scratch_path(spark, "pairs-jsonl")
    pairs = fx.rewrite_pairs(spark, sf).repartitionByRange(4, "pair_id").sortWithinPartitions("pair_id")
    pairs.withColumnRenamed("rewritten", "rewriter").write.json(path)
    numbered = read_pairs_jsonl(spark, path, numbered=True, extra="pair_id long")
    return trn.ordered_split(numbered.select("pair_id", "line_no"))


@register("sample_n", with_fixtures(
    "select pair_id from rewrite_pairs order by (((pair_id % 2147483648 + 42) % 2147483648) * 2654435761) % 4294967296, pair_id limit 100",
    "rewrite_pairs"))
def q_sample_n(spark, sf):
    return trn.sample_rows(fx.rewrite_pairs(spark, sf).select("pair_id"), "pair_id", 100)


@register("agg_confidence_histogram", with_fixtures(
    """select case when confidence = 1.0 then '1.0' when confidence >= 0.9 then '0.9-1.0' when confidence >= 0.8 then '0.8-0.9'
        when confidence >= 0.7 then '0.7-0.8' when confidence >= 0.6 then '0.6-0.7' when confidence >= 0.5 then '0.5-0.6'
        else '<0.5' end as bucket, count(*) as n, round(count(*) / (select count(*) from predictions) * 100.0, 9) as pct,
        (select min(confidence) from predictions) as min_confidence, (select max(confidence) from predictions) as max_confidence,
        round((select avg(confidence) from predictions), 9) as avg_confidence
        from predictions group by 1""", "predictions"))
def q_agg_confidence_histogram(spark, sf):
    return _r(trn.confidence_histogram(_pred(spark, sf)), ("pct", "avg_confidence"))


@register("agg_symbol_sentiment_matrix", with_fixtures(
    """select symbol, count(*) filter (where sentiment = 'TÍCH_CỰC') as positive,
        count(*) filter (where sentiment = 'TIÊU_CỰC') as negative, count(*) filter (where sentiment = 'TRUNG_TÍNH') as neutral,
        count(*) as total from all_content group by symbol""", "all_content"))
def q_agg_symbol_sentiment_matrix(spark, sf):
    return trn.symbol_sentiment_matrix(fx.all_content(spark, sf))


@register("agg_confidence_describe", with_fixtures(
    """select true_label, count(confidence) as count, round(avg(confidence), 9) as mean,
        round(stddev_samp(confidence), 9) as std, min(confidence) as min, round(quantile_cont(confidence, 0.25), 9) as p25,
        round(quantile_cont(confidence, 0.5), 9) as p50, round(quantile_cont(confidence, 0.75), 9) as p75,
        max(confidence) as max from predictions group by true_label""",
    "predictions"))
def q_agg_confidence_describe(spark, sf):
    return _r(trn.confidence_describe(_pred(spark, sf)), ("mean", "std", "p25", "p50", "p75"))


@register("agg_confusion_matrix", with_fixtures(
    """select t.l as true_label, p.l as pred_label, count(x.doc_id) as n
        from (select unnest(['negative','neutral','positive']) as l) t cross join (select unnest(['negative','neutral','positive']) as l) p
        left join predictions x on x.true_label = t.l and x.pred_label = p.l group by 1, 2""", "predictions"))
def q_agg_confusion_matrix(spark, sf):
    return trn.confusion_matrix(_pred(spark, sf))


_PC = """select coalesce(t.label, p.label) as label, coalesce(t.support, 0) as support, coalesce(p.predicted, 0) as predicted,
        coalesce(c.tp, 0) as tp
    from (select true_label as label, count(*) as support from predictions group by 1) t
    full join (select pred_label as label, count(*) as predicted from predictions group by 1) p on t.label = p.label
    left join (select true_label as label, count(*) as tp from predictions where true_label = pred_label group by 1) c
        on c.label = coalesce(t.label, p.label)"""
_PRF = """select label, support, case when predicted > 0 then tp / predicted else 0.0 end as precision,
        case when support > 0 then tp / support else 0.0 end as recall from pc"""
_PRF1 = """select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1_score
        from prf"""


@register("agg_classification_report", with_fixtures(
    """select label, round(precision, 9) as precision, round(recall, 9) as recall, round(f1_score, 9) as f1_score, support
    from (select label, precision, recall, f1_score, support from prf1
    union all select 'accuracy', null, null, (select count(*) filter (where true_label = pred_label) from predictions)
        / (select count(*) from predictions), (select count(*) from predictions)
    union all select 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) from prf1
    union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1_score * support) / sum(support), sum(support) from prf1)""",
    "predictions", extra=[("pc", _PC), ("prf", _PRF), ("prf1", _PRF1)]))
def q_agg_classification_report(spark, sf):
    return _r(trn.classification_report(_pred(spark, sf)), ("precision", "recall", "f1_score"))


@register("agg_weighted_metrics", with_fixtures(
    """select round((select count(*) filter (where true_label = pred_label) from predictions) / sum(support), 9) as accuracy,
        round(sum(precision * support) / sum(support), 9) as precision, round(sum(recall * support) / sum(support), 9) as recall,
        round(sum(f1_score * support) / sum(support), 9) as f1 from prf1""",
    "predictions", extra=[("pc", _PC), ("prf", _PRF), ("prf1", _PRF1)]))
def q_agg_weighted_metrics(spark, sf):
    return _r(trn.weighted_metrics(_pred(spark, sf)), ("accuracy", "precision", "recall", "f1"))


def _labelled_split(spark, sf):
    return trn.hash_split(fx.labelled(spark, sf), "doc_id")


_SPLIT_SQL = "(((doc_id % 2147483648 + 42) % 2147483648) * 2654435761) % 4294967296 % 100"
ACCURACY_FLOOR = 0.6


_SAVED: dict[tuple[str, str], str] = {}


def _fitted(spark, sf):
    """The classifier of the 80 % split as saved in the shared folder: fitted by the first query that asks for it."""
    from pyspark.ml import PipelineModel

    at = (spark.sparkContext.applicationId, sf)
    if at not in _SAVED:
        path = scratch_path(spark, "classifier")
        trn.train_classifier(_labelled_split(spark, sf)).write().overwrite().save(path)
        _SAVED[at] = path
    return PipelineModel.load(_SAVED[at])


@register("flow_train_classifier", with_fixtures(
    f"select label, count(*) as train_rows, true as learned from labelled where {_SPLIT_SQL} < 80 group by label", "labelled"))
def q_flow_train_classifier(spark, sf):
    """Train on the 80 % split: the rows each class was learned from, and whether the model finds most of them again."""
    data = _labelled_split(spark, sf).where("split = 'train'")
    scored = trn.evaluate_classifier(_fitted(spark, sf), data)
    right = F.avg((F.col("true_label") == F.col("pred_label")).cast("double"))
    return scored.groupBy(F.col("true_label").alias("label")).agg(F.count(F.lit(1)).alias("train_rows"), (right > 0.5).alias("learned"))


@register("flow_evaluate_classifier", with_fixtures(
    f"""select * from (with t as (select label from labelled where {_SPLIT_SQL} >= 80)
    select label, count(*) as support, true as holds from t group by label
    union all select unnest(['accuracy', 'macro avg', 'weighted avg']), count(*), true from t)""", "labelled"))
def q_flow_evaluate_classifier(spark, sf):
    """Held-out evaluation of the trained classifier, as facts that hold for any sound training run: the supports, ratios
    between 0 and 1, and an accuracy of at least ``ACCURACY_FLOOR`` that is above the share of the largest class."""
    test = _labelled_split(spark, sf).where("split = 'test'")
    report = trn.classification_report(trn.evaluate_classifier(_fitted(spark, sf), test))
    most = test.groupBy("label").count().agg(F.max("count") / F.sum("count")).scalar()
    sound = F.col("f1_score").between(0.0, 1.0) & F.coalesce(F.col("precision").between(0.0, 1.0), F.lit(True))
    good = F.when(F.col("label") == "accuracy", (F.col("f1_score") >= ACCURACY_FLOOR) & (F.col("f1_score") > most)).otherwise(F.lit(True))
    return report.select("label", "support", (sound & good).alias("holds"))


@register("flow_sentiment_score_model", f"""select doc_id, case when text is null or text = '' or length({ot.strip('text')}) < 3 then 'Text too short'
        when length({ot.strip(ot.sentiment_clean('nfc_normalize(text)'))}) < 2 then 'Text too short after cleaning' else 'custom_model' end as sentiment_source,
        true as same from documents""")
def q_flow_sentiment_score_model(spark, sf):
    """The saved classifier as scorer over all documents, beside what the fitted pipeline itself says about the cleaned text."""
    from tickpulse.functions.text import nfc, sentiment_clean
    from tickpulse.operators.sentiment import canonical_label, saved_scorer, transform_sentiment

    model = _fitted(spark, sf)
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    scorer = saved_scorer(_SAVED[spark.sparkContext.applicationId, sf], trn.CLASS_LABELS, "model_text")
    scored = transform_sentiment(docs, "text", scorer).select("doc_id", "sentiment", "sentiment_source")
    plain = model.transform(docs.select("doc_id", sentiment_clean(nfc(F.col("text"))).alias("model_text")))
    names = F.array(*[F.lit(x) for x in trn.CLASS_LABELS])
    said = canonical_label(F.element_at(names, (F.col("prediction") + 1).cast("int")))
    both = scored.join(plain.select("doc_id", said.alias("said")), "doc_id")
    same = (F.col("sentiment") == F.col("said")) | (F.col("sentiment_source") != "custom_model")
    return both.select("doc_id", "sentiment_source", same.alias("same"))


# ---------------------------------------------------------------- ROUGE
def _pairs(spark, sf):
    return fx.rewrite_pairs(spark, sf).select(F.col("pair_id").alias("id"), F.col("rewritten").alias("reference"),
                                              F.col("original").alias("prediction"))


def _ngram_sql(n: int) -> str:
    toks = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
    grams = (f"list_transform(range(1, len({toks}) - {n - 1} + 1), lambda i: array_to_string(list_slice({toks}, i, i + {n - 1}), ' '))"
             if n > 1 else toks)
    return f"""with p as (select pair_id as id, rewritten as reference, original as prediction from rewrite_pairs),
    r as (select id, g, count(*) as c from (select id, unnest({grams.format(c='reference')}) as g from p) group by 1, 2),
    q as (select id, g, count(*) as c from (select id, unnest({grams.format(c='prediction')}) as g from p) group by 1, 2),
    ov as (select r.id, sum(least(r.c, q.c)) as overlap from r join q on r.id = q.id and r.g = q.g group by 1),
    rt as (select id, sum(c) as n from r group by 1), qt as (select id, sum(c) as n from q group by 1),
    m as (select p.id, coalesce(ov.overlap, 0) as overlap, coalesce(rt.n, 0) as ref_total, coalesce(qt.n, 0) as pred_total
          from p left join ov on ov.id = p.id left join rt on rt.id = p.id left join qt on qt.id = p.id),
    s as (select id, case when pred_total > 0 then overlap / pred_total else 0.0 end as precision,
                 case when ref_total > 0 then overlap / ref_total else 0.0 end as recall from m)
    select id, round(precision, 9) as precision, round(recall, 9) as recall,
        round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end, 9) as fmeasure
    from s"""


def _r9(df):
    return df.select("id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fmeasure")])


@register("fn_rouge_1", with_fixtures(f"select * from ({_ngram_sql(1)})", "rewrite_pairs"))
def q_fn_rouge_1(spark, sf):
    return _r9(ev.rouge_n(_pairs(spark, sf), 1))


@register("fn_rouge_2", with_fixtures(f"select * from ({_ngram_sql(2)})", "rewrite_pairs"))
def q_fn_rouge_2(spark, sf):
    return _r9(ev.rouge_n(_pairs(spark, sf), 2))


# longest common subsequence of two token lists: one row of the table per token of the first, cell by cell
_LCS = """list_reduce(list_transform(a, lambda x: {'t': x, 'r': []::INT[]}),
    lambda acc, e: {'t': '', 'r': list_reduce(list_transform(range(1, len(b) + 1), lambda j: {'j': j::INT, 'c': []::INT[]}),
        lambda cur, k: {'j': 0, 'c': list_append(cur.c, case when b[k.j] = e.t then acc.r[k.j] + 1
            else greatest(acc.r[k.j + 1], cur.c[k.j]) end)},
        {'j': 0, 'c': [0]::INT[]}).c},
    {'t': '', 'r': list_resize([0]::INT[], len(b) + 1, 0)}).r[len(b) + 1]"""
_ROUGE_L_SQL = f"""with p as (select pair_id as id, regexp_extract_all(lower(rewritten), '[a-z0-9]+') as a,
        regexp_extract_all(lower(original), '[a-z0-9]+') as b from rewrite_pairs),
    m as (select id, len(a) as ref_total, len(b) as pred_total,
        case when len(a) > 0 and len(b) > 0 then {_LCS} else 0 end as overlap from p),
    s as (select id, case when pred_total > 0 then overlap / pred_total else 0.0 end as precision,
        case when ref_total > 0 then overlap / ref_total else 0.0 end as recall from m)
    select id, round(precision, 9) as precision, round(recall, 9) as recall,
        round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end, 9) as fmeasure
    from s"""


@register("fn_rouge_l", with_fixtures(f"select * from ({_ROUGE_L_SQL})", "rewrite_pairs"))
def q_fn_rouge_l(spark, sf):
    return _r9(ev.rouge_l(_pairs(spark, sf)))


_MEANS_SQL = f"""select round((select avg(fmeasure) from ({_ngram_sql(1)})), 6) as rouge1,
        round((select avg(fmeasure) from ({_ngram_sql(2)})), 6) as rouge2,
        round((select avg(fmeasure) from ({_ROUGE_L_SQL})), 6) as "rougeL", (select count(*) from rewrite_pairs) as pairs"""


def _means(pairs):
    m = ev.rouge_means(pairs)
    return m.select(*[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "rougeL")], "pairs")


@register("agg_rouge_mean", with_fixtures(_MEANS_SQL, "rewrite_pairs"))
def q_agg_rouge_mean(spark, sf):
    return _means(_pairs(spark, sf))


# every third original opens with a cue; what the rules make of it is the prediction
_CUED_PAIRS_SQL = "select pair_id, case when pair_id % 3 = 0 then 'Nghe đồn ' || original else original end as cued, rewritten from rewrite_pairs"
_RULED = f"(case when length({ot.strip('cued')}) < 3 then cued else {ot.rewrite_rules('cued')} end)"
_SAID_PAIRS_SQL = f"select pair_id, case when {_RULED} is null or length({ot.strip(_RULED)}) < 3 then cued else {_RULED} end as original, rewritten from ({_CUED_PAIRS_SQL})"


@register("flow_evaluate_rewriter", with_fixtures(_MEANS_SQL.replace("rewrite_pairs", "said_pairs"), "rewrite_pairs", extra=[("said_pairs", _SAID_PAIRS_SQL)]))
def q_flow_evaluate_rewriter(spark, sf):
    """Rewrite every original with the rule rewriter and score it against its reference (texts without a cue stay as they are)."""
    from tickpulse.functions.rumor_rules import accept_rewrite, rewrite_text

    s = fx.rewrite_pairs(spark, sf)
    cued = F.when(F.col("pair_id") % 3 == 0, F.concat(F.lit("Nghe đồn "), F.col("original"))).otherwise(F.col("original"))
    s = s.withColumn("original", cued)
    return _means(s.select(F.col("pair_id").alias("id"), F.col("rewritten").alias("reference"),
                           accept_rewrite(rewrite_text(F.col("original")), F.col("original")).alias("prediction")))
