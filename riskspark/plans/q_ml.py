"""Split / train / evaluate / score queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.features import build_features
from ..operators import counters as ct
from ..operators import ml
from ..session import checkpoint_path
from ..sources import fixtures as fx
from .catalog import register, with_tx
from .q_sources import METRIC_ROWS

CM = """cast(count(case when fraud_score > 0.5 and is_fraud = 1 then 1 end) as bigint) as tp,
  cast(count(case when fraud_score > 0.5 and is_fraud != 1 then 1 end) as bigint) as fp,
  cast(count(case when not (fraud_score > 0.5) and is_fraud = 1 then 1 end) as bigint) as fn,
  cast(count(case when not (fraud_score > 0.5) and is_fraud != 1 then 1 end) as bigint) as tn"""


@register("confusion_matrix", with_tx(f"select {CM} from tx"))
def confusion_matrix(spark, sf):
    return ml.confusion_matrix(fx.tx(spark, sf))


@register("confusion_by_category", with_tx(f"select category, {CM} from tx group by category"))
def confusion_by_category(spark, sf):
    return ml.confusion_matrix(fx.tx(spark, sf), by=["category"])


@register("classification_report", with_tx(f"""
, cm as (select {CM} from tx)
select tp, fp, fn, tn,
  case when tp + fp + fn + tn > 0 then cast(tp + tn as double) / (tp + fp + fn + tn) else 0.0 end as accuracy,
  case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0.0 end as precision,
  case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0.0 end as recall,
  case when fp + tn > 0 then cast(fp as double) / (fp + tn) else 0.0 end as fpr,
  cast(tp + fp + fn + tn as bigint) as samples_evaluated
from cm"""))
def classification_report(spark, sf):
    return ml.classification_report(ml.confusion_matrix(fx.tx(spark, sf)))


@register("class_distribution", with_tx("""
select cast(count(case when is_fraud = 1 then 1 end) as bigint) as positives,
  cast(count(case when is_fraud != 1 then 1 end) as bigint) as negatives from tx"""))
def class_distribution(spark, sf):
    return ml.class_distribution(fx.tx(spark, sf))


@register("class_weight", with_tx("""
, d as (select cast(count(case when is_fraud = 1 then 1 end) as bigint) as positives,
  cast(count(case when is_fraud != 1 then 1 end) as bigint) as negatives from tx)
select positives, negatives,
  case when positives > 0 then cast(negatives as double) / greatest(positives, 1) else 1.0 end as scale_pos_weight from d"""))
def class_weight(spark, sf):
    return ml.scale_pos_weight(ml.class_distribution(fx.tx(spark, sf)))


@register("logloss", with_tx("""
select round(avg(-(cast(is_fraud as double) * ln(least(greatest(fraud_score, 1e-15), 1 - 1e-15))
                  + (1 - cast(is_fraud as double)) * ln(1 - least(greatest(fraud_score, 1e-15), 1 - 1e-15)))), 9) as logloss,
  cast(count(*) as bigint) as n from tx"""))
def logloss(spark, sf):
    return ml.logloss(fx.tx(spark, sf)).withColumn("logloss", F.round("logloss", 9))


SPLIT_KEYS = ["unix_time", "trans_key", "cc_num", "amt", "fraud_score"]


@register("ordered_split_counts", with_tx(f"""
, r as (select *, row_number() over (order by {', '.join(SPLIT_KEYS)}) as rn, count(*) over () as n from tx)
select case when rn <= n - cast(floor(n * 0.2) as bigint) then 'train' else 'test' end as split,
  cast(count(*) as bigint) as n, cast(sum(is_fraud) as bigint) as n_fraud,
  cast(sum(cast(amt as decimal(18,2))) as double) as amount, min(unix_time) as min_time, max(unix_time) as max_time
from r group by 1"""))
def ordered_split_counts(spark, sf):
    """M1: last 20 % of rows by time (tie keys after) form the test set; both
    sides are counted in one pass over the split flag."""
    m = ml.mark_split(fx.tx(spark, sf), 0.2, SPLIT_KEYS)
    return m.groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("split")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.sum("is_fraud").cast("bigint").alias("n_fraud"),
        F.sum(F.col("amt").cast("decimal(18,2)")).cast("double").alias("amount"),
        F.min("unix_time").alias("min_time"), F.max("unix_time").alias("max_time"))


DEFAULTS = {"total_txns_scored": 0.0, "fraud_blocked_count": 0.0, "model_accuracy": 0.0,
            "model_precision": 0.0, "fraud_dist_high": 0.0}


@register("report_with_defaults", with_tx(METRIC_ROWS + f""",
exp as (select * from (values {', '.join(f"('{k}', {v})" for k, v in DEFAULTS.items())}) e(name, "default"))
select exp.name, coalesce(cast(folded.value as double), exp."default") as value, folded.value is null as is_default
from exp left join folded on folded.name = exp.name"""))
def report_with_defaults(spark, sf):
    """Expected KPIs with their value or a flagged default."""
    folded = ct.metric_fold(ct.batch_counters(fx.tx_batches(spark, sf)))
    return ml.report_with_defaults(folded, DEFAULTS)


def _features(spark, sf):
    return build_features(fx.tx(spark, sf).drop("fraud_score"))


SPLIT_SQL = """
, r as (select *, row_number() over (order by unix_time, trans_key) as rn, count(*) over () as n from tx),
test as (select * from r where rn > n - cast(floor(n * 0.2) as bigint))"""


@register("fit_score", None)
def fit_score(spark, sf):
    """M1-M5, P1 (rows-only): features -> ordered split -> GBT (100 rounds, depth 8, cut at the best
    round of the test part) -> scores of the test rows."""
    feats = _features(spark, sf)
    train, test = ml.ordered_split(feats, 0.2, ["unix_time", "trans_key"])
    model = ml.fit_risk_model(train, test)
    return ml.score(test, model).select("trans_key", "unix_time", "is_fraud", "fraud_score", "fraud_prediction")


@register("evaluate_latest", None)
def evaluate_latest(spark, sf):
    """Train, register a version in the shared checkpoint folder, evaluate the newest version on the newest
    20 % of rows and write the rates to the metric store: the confusion counts, the rates and the number of stored
    gauges (held against the batch scores of that model in ``tests/test_ml.py``)."""
    root = checkpoint_path(spark, "models", uuid.uuid4().hex)
    feats = _features(spark, sf)
    train, test = ml.ordered_split(feats, 0.2, ["unix_time", "trans_key"])
    model = ml.fit_risk_model(train, None)
    ml.register_model(model, root, metrics={"rounds": 100})
    rep = ml.evaluate_latest(test, root, metrics=f"{root}/_metrics")
    gauges = ct.metric_fold(spark.read.parquet(f"{root}/_metrics")).agg(F.count(F.lit(1)).alias("gauges"))
    return rep.join(gauges)  # two single rows


@register("model_auc", with_tx("""
, r as (select is_fraud, rank() over (order by fraud_score) as lo_rank,
               count(*) over (partition by fraud_score) as ties from tx),
s as (select sum(case when is_fraud = 1 then lo_rank + (ties - 1) / 2.0 end) as rank_sum,
             count(case when is_fraud = 1 then 1 end) as p, count(case when is_fraud != 1 then 1 end) as q from r)
select round((rank_sum - p * (p + 1) / 2.0) / (cast(p as double) * q), 9) as auc, cast(p + q as bigint) as n from s"""))
def model_auc(spark, sf):
    """M6: ROC AUC of the score against the label (Spark's evaluator)."""
    tx = fx.tx(spark, sf)
    value = ml.auc(tx)
    n = tx.count()
    return spark.createDataFrame([(round(value, 9), n)], "auc double, n long")


@register("prediction_flags", with_tx("""
select trans_key, fraud_score, cast(fraud_score >= 0.52 as int) as fraud_prediction,
  case when fraud_score < 0.6 then 'low' when fraud_score < 0.9 then 'medium' else 'high' end as risk_band
from tx"""))
def prediction_flags(spark, sf):
    """serving flag (score >= 0.52) and risk band per row."""
    from ..functions.features import fraud_prediction, risk_band
    return fx.tx(spark, sf).select("trans_key", "fraud_score", fraud_prediction().alias("fraud_prediction"),
                                   risk_band().alias("risk_band"))
