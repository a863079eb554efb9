"""Split sizes, disjointness, evaluation invariants, scoring range, registry."""

import inspect
import uuid

import pytest
from pyspark.sql import functions as F

from riskspark.functions.features import build_features
from riskspark.operators import ml
from riskspark.plans import catalog
from riskspark.session import checkpoint_path
from riskspark.sources import fixtures as fx
from support import SF_SMALL


def test_ordered_split_sizes_and_order(spark):
    tx = fx.tx(spark, SF_SMALL)
    n = tx.count()
    train, test = ml.ordered_split(tx, 0.2, ["unix_time", "trans_key"])
    assert test.count() == int(n * 0.2) and train.count() == n - int(n * 0.2)
    assert train.agg(F.max("unix_time")).first()[0] <= test.agg(F.min("unix_time")).first()[0]
    def checksum(d):
        return d.agg(F.sum(F.xxhash64(*[F.col(c) for c in tx.columns]).cast("decimal(38,0)"))).first()[0]
    assert checksum(train) + checksum(test) == checksum(tx)


def test_ordered_split_with_identical_rows_at_the_cut(spark):
    rows = [(i, float(i)) for i in range(10)] + [(10, 1.0)] * 10
    df = spark.createDataFrame(rows, "t long, v double")
    train, test = ml.ordered_split(df, 0.25, ["t"])          # 20 rows -> 5 test, cut inside the tied group
    assert test.count() == 5 and train.count() == 15
    assert test.where("t = 10").count() == 5


def test_confusion_invariants(spark):
    tx = fx.tx(spark, SF_SMALL)
    cm = ml.classification_report(ml.confusion_matrix(tx)).first()
    assert cm.tp + cm.fp + cm.fn + cm.tn == tx.count() == cm.samples_evaluated
    assert 0 <= cm.precision <= 1 and 0 <= cm.recall <= 1 and 0 <= cm.fpr <= 1


def test_fit_score_register_and_reload(spark):
    feats = build_features(fx.tx(spark, SF_SMALL).drop("fraud_score"))
    train, test = ml.ordered_split(feats, 0.2, ["unix_time", "trans_key"])
    model = ml.fit_risk_model(train, test, depth=3, rounds=3)
    scored = ml.score(test, model)
    s = scored.agg(F.min("fraud_score"), F.max("fraud_score"), F.count(F.lit(1))).first()
    assert 0.0 <= s[0] <= s[1] <= 1.0 and s[2] == test.count()
    assert set(scored.columns) >= set(test.columns) | {"fraud_score", "fraud_prediction"}
    root = checkpoint_path(spark, "test-models", uuid.uuid4().hex)
    assert ml.latest_version(spark, root) is None
    assert ml.register_model(model, root).version == 1
    assert ml.register_model(model, root).version == 2
    rep = ml.evaluate_latest(test, root).first()
    assert rep.model_version == 2 and rep.samples_evaluated == test.count()


@pytest.mark.parametrize("query", ["fit_score", "evaluate_latest", "stream_scores"])
def test_registered_queries_train_the_full_model(spark, monkeypatch, query):
    class Called(Exception):
        pass

    signature = inspect.signature(ml.fit_risk_model)

    def fit(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        raise Called(bound.arguments["depth"], bound.arguments["rounds"])

    monkeypatch.setattr(ml, "fit_risk_model", fit)
    with pytest.raises(Called) as seen:
        catalog.queries()[query](spark, SF_SMALL)
    assert seen.value.args == (8, 100)


def test_best_round_waits_for_patience():
    flat = [1.0, 0.9, 0.95, 0.96, 0.94, 0.8, 0.81, 0.82, 0.83]
    assert ml.best_round(flat, 3) == 2      # three rounds without gain: the search ends before round 6
    assert ml.best_round(flat, 4) == 6
    assert ml.best_round([0.5], 10) == 1 and ml.best_round([3.0, 2.0, 1.0], 1) == 3
    slow = [1.0 - 0.001 * i for i in range(50)]  # small gains each round: a tolerance of 0.01 would stop at once
    assert ml.best_round(slow, 10) == 50


def test_model_cut_at_the_best_round_scores_as_one_trained_to_it(spark):
    feats = build_features(fx.tx(spark, SF_SMALL).drop("fraud_score"))
    train, test = ml.ordered_split(feats, 0.2, ["unix_time", "trans_key"])
    full = ml.fit_risk_model(train, None, depth=3, rounds=8)
    losses = ml.round_losses(full, test)
    assert len(losses) == 8
    scores = lambda m: sorted((r.trans_key, r.fraud_score) for r in ml.score(test, m).select("trans_key", "fraud_score").collect())
    assert scores(ml.cut_model(full, 3)) == scores(ml.fit_risk_model(train, None, depth=3, rounds=3))
    stopped = ml.fit_risk_model(train, test, depth=3, rounds=8, patience=2)
    assert stopped.stages[-1].getNumTrees == ml.best_round(losses, 2)
    assert scores(stopped) == scores(ml.cut_model(full, ml.best_round(losses, 2)))
    root = checkpoint_path(spark, "test-models", uuid.uuid4().hex)  # a cut model can be stored
    assert scores(ml.load_model(ml.register_model(stopped, root))) == scores(stopped)


def test_training_rows_are_bounded(spark, monkeypatch):
    feats = build_features(fx.tx(spark, SF_SMALL).drop("fraud_score")).cache()
    n, seen = feats.count(), []
    fit = ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, t: seen.append(t.count()) or fit(self, t))
    ml.fit_risk_model(feats, None, depth=2, rounds=1, most_rows=n // 4)
    ml.fit_risk_model(feats, None, depth=2, rounds=1, most_rows=n)
    assert 0.7 * n / 4 < seen[0] < 1.3 * n / 4 and seen[1] == n


def test_stream_scores_and_evaluation_equal_the_batch(spark, monkeypatch):
    """With a small model: the stream's scores are the batch scores of the registered model, and the evaluation's
    counts and rates those of these scores."""
    fit = ml.fit_risk_model
    models = []
    monkeypatch.setattr(ml, "fit_risk_model", lambda *a, **o: models.append(fit(*a, **(o | {"depth": 3, "rounds": 3}))) or models[-1])
    got = catalog.queries()["stream_scores"](spark, SF_SMALL).collect()
    feats = build_features(fx.tx(spark, SF_SMALL).drop("fraud_score"))
    key = lambda r: (r.trans_key, r.unix_time, r.fraud_score, r.fraud_prediction)
    assert sorted(map(key, got)) == sorted(map(key, ml.score(feats, models[0]).collect()))
    assert {r.model_version for r in got} == {1} and len({r.batch_id for r in got}) > 1
    rep = catalog.queries()["evaluate_latest"](spark, SF_SMALL).first()
    _, test = ml.ordered_split(feats, 0.2, ["unix_time", "trans_key"])
    want = {"tp": 0, "fp": 0, "fn": 0, "tn": 0}
    for r in ml.score(test, models[1]).select("fraud_score", "is_fraud").collect():
        want[("t" if (r.fraud_score > 0.5) == (r.is_fraud == 1) else "f") + ("p" if r.fraud_score > 0.5 else "n")] += 1
    assert {k: rep[k] for k in want} == want and rep.samples_evaluated == sum(want.values()) and rep.gauges == 5
    assert rep.accuracy == pytest.approx((want["tp"] + want["tn"]) / sum(want.values()))
    assert rep.recall == pytest.approx(want["tp"] / max(1, want["tp"] + want["fn"]))


def test_report_with_defaults_flags_missing(spark):
    vals = spark.createDataFrame([("a", 3.0)], "name string, value double")
    got = {r.name: (r.value, r.is_default) for r in ml.report_with_defaults(vals, {"a": 0.0, "b": 9.0}).collect()}
    assert got == {"a": (3.0, False), "b": (9.0, True)}


def test_training_partitions_follow_the_slots_and_stay_bounded():
    assert ml.train_partitions(0, 12) == 1
    assert ml.train_partitions(60_000, 12) == 2
    assert ml.train_partitions(2_880_000, 12) == 12          # one wave, not 58 tasks at every level
    assert ml.train_partitions(172_800_000, 12) == 346       # 500,000 rows a task at most
