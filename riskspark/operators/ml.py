"""Split, train, evaluate, register and score (M1-M13, P1) with Spark ML.

The model is a ``Pipeline`` of ``VectorAssembler`` (the 20 ordered features,
missing ones as 0) and a ``GBTClassificationModel`` with the reference's settings
(depth 8, step 0.1, 100 rounds, logistic loss), positives weighted by class, cut at
the round with the least test loss.  Training data is never collected: the split is a
filter on an exact cut, the class counts are one aggregate, and ``boosting`` trains on
the distributed frame.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import FRAUD_THRESHOLD, MODEL_FEATURES, model_columns
from ..session import ensure_checkpoint_dir
from ..sources.metric_store import write_metrics
from . import boosting
from .counters import VALUE
from .selection import at_cut, kth_cut, upto_cut

EVAL_THRESHOLD = 0.5          # evaluation counts score > 0.5 (serving uses >= 0.52)
MIN_TRAIN_ROWS = 1000
MIN_EVAL_ROWS = 100


# ------------------------------------------------------------------ M1 split
def mark_split(df: DataFrame, fraction: float = 0.2, keys: Sequence[str] = ("unix_time",)) -> DataFrame:
    """M1: ``df`` with ``is_test``: true for the last ``fraction`` of rows in
    ``keys`` order, exactly int(n * fraction) rows.

    A hash of the whole row is the last sort key, so the order is total
    except for rows identical in every column, which are interchangeable.
    The boundary is found by an exact distributed search (``selection``); the
    flag is then one struct comparison -- no global sort, no window.
    """
    cols = list(keys)
    d = df.withColumn("_split_h", F.xxhash64(*[F.col(c) for c in df.columns]))
    order = [*cols, "_split_h"]
    n = d.count()
    n_test = int(n * fraction)
    n_train = n - n_test
    if n_train <= 0 or n_test <= 0:
        return d.withColumn("is_test", F.lit(n_train <= 0)).drop("_split_h")
    cut = kth_cut(d, order, n_train, n=n)
    at, upto = at_cut(d, order, cut), upto_cut(d, order, cut)
    n_at = cut.n_at if cut.n_at is not None else d.where(at).count()
    if cut.take >= n_at:
        return d.withColumn("is_test", ~upto).drop("_split_h")
    # identical rows straddle the cut: number them once (checkpointed, so the
    # numbering is stable) and send the first ``take`` of them to train
    ensure_checkpoint_dir(df.sparkSession)  # the shared folder named by spark.checkpoint.dir
    tie = d.where(at).withColumn("_tie_id", F.monotonically_increasing_id()).checkpoint()
    tcut = kth_cut(tie, ["_tie_id"], cut.take, n=n_at)
    tie = tie.withColumn("is_test", F.col("_tie_id") > F.lit(tcut.key[0])).drop("_tie_id")
    rest = d.where(~at).withColumn("is_test", ~upto)
    return rest.unionByName(tie).drop("_split_h")


def ordered_split(df: DataFrame, fraction: float = 0.2, keys: Sequence[str] = ("unix_time",)
                  ) -> tuple[DataFrame, DataFrame]:
    """M1: (train, test) -- the last ``fraction`` of rows in ``keys`` order is
    the test set, test size = int(n * fraction).  See ``mark_split``."""
    m = mark_split(df, fraction, keys)
    return m.where(~F.col("is_test")).drop("is_test"), m.where(F.col("is_test")).drop("is_test")


# ------------------------------------------------------------------ M2, M3
def class_distribution(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """M2: positives and negatives."""
    return df.agg(F.count(F.when(F.col(label) == 1, 1)).cast("bigint").alias("positives"),
                  F.count(F.when(F.col(label) != 1, 1)).cast("bigint").alias("negatives"))


def scale_pos_weight(dist: DataFrame) -> DataFrame:
    """M3: negatives / max(positives, 1); 1.0 without positives."""
    p, q = F.col("positives"), F.col("negatives")
    return dist.withColumn("scale_pos_weight",
                           F.when(p > 0, q.cast("double") / F.greatest(p, F.lit(1))).otherwise(F.lit(1.0)))


# ------------------------------------------------------------------ M4, M5
#: Rows per training task: tasks meet at every tree level, so small inputs get few of them.
TRAIN_ROWS_PER_TASK = 50_000
#: Rows per partition once every task slot has one.
MOST_TRAIN_ROWS_PER_TASK = 500_000


def train_partitions(n: int, slots: int) -> int:
    """Partitions of ``n`` training rows: one wave of tasks as long as these hold ``MOST_TRAIN_ROWS_PER_TASK`` rows at most."""
    return max(1, min(slots, -(-n // TRAIN_ROWS_PER_TASK)), -(-n // MOST_TRAIN_ROWS_PER_TASK))


def fit_risk_model(train: DataFrame, test: DataFrame | None = None, cols: Sequence[str] = MODEL_FEATURES,
                   label: str = "is_fraud", depth: int = 8, rate: float = 0.1, rounds: int = 100,
                   patience: int = 10, seed: int = 42, most_rows: int | None = None) -> PipelineModel:
    """M4/M5: boosted trees on the ordered features.

    Positives are weighted by scale_pos_weight (one aggregate).  With a test set, the model is cut at the round
    with the least test log loss, the rounds being looked at until ``patience`` of them in a row bring no gain
    (see ``best_round``).

    Rows are binned once and stay with their tasks for all levels and rounds (see ``boosting``).
    ``most_rows`` bounds the training rows: each row is drawn with the same probability,
    by a hash of its inputs, so that about this many stay; all rows count for the weight of positives."""
    dist = scale_pos_weight(class_distribution(train, label)).first()
    n, w = dist["positives"] + dist["negatives"], dist["scale_pos_weight"]
    t = train.select(*_inputs(train, cols), F.col(label).cast("double").alias("label"))
    if most_rows is not None and n > most_rows:
        part = F.pmod(F.xxhash64(F.lit(seed), *t.columns), F.lit(1 << 30)) / float(1 << 30)
        t, n = t.where(part < most_rows / n), most_rows
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxDepth=depth,
                        stepSize=rate, maxIter=rounds, lossType="logistic", seed=seed, maxBins=64, featureSubsetStrategy="all")
    assembler = VectorAssembler(inputCols=[f"_mf_{c}" for c in cols], outputCol="features", handleInvalid="keep")
    slots = train.sparkSession.sparkContext.defaultParallelism
    trees = boosting.BoostedTrees(gbt, assembler.getInputCols(), "label", float(w), min(train_partitions(n, slots), slots))
    model = Pipeline(stages=[assembler, trees]).fit(t)
    if test is None:
        return model
    losses = round_losses(model, test, cols, label)
    return cut_model(model, best_round(losses, patience)) if losses else model


def round_losses(model: PipelineModel, test: DataFrame, cols: Sequence[str] = MODEL_FEATURES, label: str = "is_fraud") -> list[float]:
    """Mean log loss on ``test`` after each round, rows unweighted (empty without rows)."""
    return boosting.losses(model.stages[-1], test.select(*_inputs(test, cols), F.col(label).cast("double").alias("label")))


def best_round(losses: Sequence[float], patience: int) -> int:
    """Rounds up to the best one, the search ending once ``patience`` rounds in a row were no better."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def cut_model(model: PipelineModel, rounds: int) -> PipelineModel:
    """The model with its first ``rounds`` trees: what training for so many rounds gives, without training again."""
    clf = model.stages[-1]
    if rounds >= clf.getNumTrees:
        return model
    gateway, java = model.stages[-1]._java_obj, SparkSession.getActiveSession().sparkContext._gateway
    tree_class = java.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = java.new_array(tree_class, rounds), java.new_array(java.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = gateway.trees()[i], float(clf.treeWeights[i])
    cut = java.jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        gateway.uid(), trees, weights, gateway.numFeatures(), gateway.numClasses())
    return PipelineModel([*model.stages[:-1], GBTClassificationModel(gateway.copyValues(cut, gateway.extractParamMap()))])


def _inputs(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """F16: the ordered model inputs as doubles (missing -> 0), named ``_mf_<feature>``."""
    return [c.alias(f"_mf_{n}") for c, n in zip(model_columns(df, list(cols)), cols)]


# ------------------------------------------------------------------ P1 scoring
def score(df: DataFrame, model: PipelineModel, cols: Sequence[str] = MODEL_FEATURES,
          threshold: float = FRAUD_THRESHOLD) -> DataFrame:
    """Positive-class probability as ``fraud_score`` and ``fraud_prediction``
    (score >= threshold).  The feature columns are rebuilt in order with
    missing ones as 0, then the original columns are kept."""
    inputs = dict(zip((f"_mf_{n}" for n in cols), model_columns(df, list(cols))))
    p = boosting.probability(model.stages[-1])(*[inputs[c] for c in model.stages[0].getInputCols()])
    res = df.select("*", p.alias("fraud_score"))
    return res.withColumn("fraud_prediction", (F.col("fraud_score") >= threshold).cast("int"))


# ------------------------------------------------------------------ M6-M8
def confusion_matrix(df: DataFrame, threshold: float = EVAL_THRESHOLD, score_col: str = "fraud_score",
                     label: str = "is_fraud", by: Sequence[str] = ()) -> DataFrame:
    """M7: TP/FP/FN/TN with prediction = score > threshold (strict)."""
    pred = F.col(score_col) > threshold
    y = F.col(label) == 1
    aggs = [F.count(F.when(pred & y, 1)).cast("bigint").alias("tp"),
            F.count(F.when(pred & ~y, 1)).cast("bigint").alias("fp"),
            F.count(F.when(~pred & y, 1)).cast("bigint").alias("fn"),
            F.count(F.when(~pred & ~y, 1)).cast("bigint").alias("tn")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def classification_report(cm: DataFrame) -> DataFrame:
    """M8: accuracy, precision, recall, false-positive rate; 0 when a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return cm.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
                     ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"),
                     (tp + fp + fn + tn).cast("bigint").alias("samples_evaluated"))


def logloss(df: DataFrame, score_col: str = "fraud_score", label: str = "is_fraud", eps: float = 1e-15) -> DataFrame:
    """M6: mean binary log loss with the probability clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col(score_col).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return df.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("logloss"),
                  F.count(F.lit(1)).cast("bigint").alias("n"))


def auc(scored: DataFrame, score_col: str = "fraud_score", label: str = "is_fraud") -> float:
    """M6: area under the ROC curve with Spark's evaluator (a distributed sort
    and per-partition cumulative counts); ``numBins=0`` keeps every distinct
    score, so ties count one half as in the rank formula."""
    ev = BinaryClassificationEvaluator(rawPredictionCol=score_col, labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    return ev.evaluate(scored.select(F.col(score_col).cast("double"), F.col(label).cast("double").alias("label")))


def min_sample_gate(df: DataFrame, n: int = MIN_TRAIN_ROWS) -> bool:
    """M9: at least ``n`` rows? (reads at most n rows)."""
    return df.limit(n).count() >= n


# ------------------------------------------------------------------ M10-M12 registry
@dataclass
class ModelVersion:
    version: int
    path: str


REGISTRY = "_registry"


def registry_table(spark: SparkSession, root: str) -> DataFrame | None:
    """The registry table ``root/_registry`` (version, path, created,
    features, metrics); None before the first registration.  Everything goes
    through Spark's readers/writers, so ``root`` can be any shared file system."""
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/{REGISTRY}")
    except AnalysisException as e:  # only a missing folder means that nothing was registered yet
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest_version(spark: SparkSession, root: str) -> ModelVersion | None:
    """Newest registered version (max over the registry rows)."""
    reg = registry_table(spark, root)
    if reg is None:
        return None
    row = reg.orderBy(F.col("version").desc()).select("version", "path").first()
    return ModelVersion(int(row["version"]), row["path"]) if row else None


def find_version(spark: SparkSession, root: str, version: int) -> ModelVersion | None:
    """The registered version of this number."""
    reg = registry_table(spark, root)
    row = reg.where(F.col("version") == version).select("version", "path").first() if reg is not None else None
    return ModelVersion(int(row["version"]), row["path"]) if row else None


def next_version(spark: SparkSession, root: str) -> int:
    mv = latest_version(spark, root)
    return mv.version + 1 if mv else 1


def register_model(model: PipelineModel, root: str, features: Sequence[str] = MODEL_FEATURES,
                   metrics: dict | None = None, version: int | None = None) -> ModelVersion:
    """Save the pipeline under ``root/<version>/model``, then append its
    registry row (feature list and metrics as JSON).  The row is written
    last, so readers never see a version whose model is incomplete."""
    spark = SparkSession.getActiveSession()
    version = version or next_version(spark, root)
    path = f"{root.rstrip('/')}/{version}"
    model.write().save(f"{path}/model")  # fails where this version exists, also for the slower of two writers
    row = [(version, path, time.time(), json.dumps(list(features)), json.dumps(metrics or {}))]
    (spark.createDataFrame(row, "version int, path string, created double, features string, metrics string")
     .coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/{REGISTRY}"))
    return ModelVersion(version, path)


def load_model(mv: ModelVersion) -> PipelineModel:
    return PipelineModel.load(f"{mv.path}/model")


#: Names of the evaluation gauges in the metric store and the report columns they hold.
EVAL_METRICS = {"model_accuracy": "accuracy", "model_precision": "precision", "model_recall": "recall",
                "model_fpr": "fpr", "model_samples_evaluated": "samples_evaluated"}


def evaluate_latest(features: DataFrame, root: str, threshold: float = EVAL_THRESHOLD,
                    metrics: str | None = None, batch_id: int = 0) -> DataFrame | None:
    """Score the given features with the newest model and report the
    confusion matrix and rates (None without a model or with < 100 rows).
    With ``metrics``, the rates are also written to that metric store as the
    gauges of ``batch_id`` (written again, they replace each other)."""
    mv = latest_version(features.sparkSession, root)
    if mv is None or not min_sample_gate(features, MIN_EVAL_ROWS):
        return None
    scored = score(features, load_model(mv))
    rep = classification_report(confusion_matrix(scored, threshold)).withColumn("model_version", F.lit(mv.version))
    if metrics is None:
        return rep
    rep = features.sparkSession.createDataFrame(rep.collect(), rep.schema)  # one row, computed once
    gauges = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast(VALUE).alias("value")) for n, c in EVAL_METRICS.items()]))
    write_metrics(rep.select(gauges.alias("g")).select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), "g.name", F.lit("gauge").alias("kind"), "g.value",
        F.current_timestamp().alias("ts")), metrics)
    return rep


def report_with_defaults(values: DataFrame, defaults: dict[str, float], name: str = "name",
                         value: str = "value") -> DataFrame:
    """Every expected KPI with its value, or its default and ``is_default``
    = true when the store has no value (instead of a silent default)."""
    spark = values.sparkSession
    exp = spark.createDataFrame(list(defaults.items()), f"{name} string, default double")
    j = exp.join(values.where(F.col(name).isin(list(defaults))).select(name, value), name, "left")
    return j.select(name, F.coalesce(F.col(value).cast("double"), F.col("default")).alias("value"),
                    F.col(value).isNull().alias("is_default"))
