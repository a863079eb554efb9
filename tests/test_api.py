"""Small API pieces: optional features, velocity, metric rows, pressure edges, sample filters."""

import datetime as dt

from pyspark.sql import functions as F

from riskspark.functions.features import build_features, velocity
from riskspark.operators import counters as ct
from riskspark.operators import pressure as pr
from riskspark.operators import samples as sm
from riskspark.sources import fixtures as fx
from support import SF_SMALL


def test_optional_features_follow_the_schema(spark):
    df = spark.createDataFrame([(12.5, "shopping_net")], "amt double, category string")
    cols = build_features(df).columns
    assert "amt_log" in cols and "category_encoded" in cols
    assert not {"hour_of_day", "distance_km", "state_encoded", "zip_region"} & set(cols)
    timed = spark.createDataFrame([(86400 * 5 + 23 * 3600, "CA", "M", "x")], "unix_time long, state string, gender string, street string")
    r = build_features(timed).first()
    assert (r.hour_of_day, r.day_of_week, r.is_weekend, r.is_night, r.gender_encoded) == (23, 5, 1, 1, 1)
    assert "street" not in build_features(timed).columns and "gender" not in build_features(timed).columns
    assert build_features(timed, weekday_mode="calendar").first().day_of_week == 1   # 1970-01-06 is a Tuesday


def test_velocity(spark):
    rows = [(1, 0, 10.0), (1, 1800, 5.0), (1, 3600, 1.0), (1, 7300, 2.0), (2, 100, 7.0)]
    df = spark.createDataFrame(rows, "cc_num long, unix_time long, amt double")
    got = {(r.cc_num, r.unix_time): (r.txn_count_3600s, r.amount_3600s) for r in velocity(df).collect()}
    assert got[(1, 3600)] == (3, 16.0) and got[(1, 7300)] == (1, 2.0) and got[(2, 100)] == (1, 7.0)


def test_metric_increment_and_set(spark):
    df = spark.range(10).withColumn("amt", F.col("id") * 1.5)
    inc = ct.metric_increment(df, 7, "total_txns_scored")
    gauge = ct.metric_set(df, 7, "model_version_loaded", F.lit(3))
    folded = {r.name: float(r.value) for r in ct.metric_fold(inc.unionByName(gauge)).collect()}
    assert folded == {"total_txns_scored": 10.0, "model_version_loaded": 3.0}


def test_queue_pressure_levels(spark):
    backlog = spark.createDataFrame([("raw-transactions", 2_800_000), ("training-queue", 100), ("other", 4_600)],
                                    "topic string, count long")
    got = {r.topic: (r.pressure_pct, r.status) for r in pr.queue_pressure(backlog, fx.queue_limits(spark)).collect()}
    assert got == {"raw-transactions": (93, "Critical"), "training-queue": (2, "Normal"), "other": (92, "Critical")}
    act = {r.topic: (r.level, r.action) for r in pr.threshold_action(backlog, fx.queue_limits(spark)).collect()}
    assert act["raw-transactions"] == ("warning", "throttle_generation") and act["other"] == ("ok", None)


def test_counter_reset_and_filters(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("c", {"mode": "idle"}, t0 + dt.timedelta(minutes=m), v) for m, v in ((0, 10.0), (10, 30.0), (20, 5.0), (30, 8.0))]
    rows += [("c", {"mode": "user"}, t0, 1.0), ("d", {"mode": "idle"}, t0, 1.0)]
    s = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double")
    r = sm.counter_rate(s, 3600, metric="c", match={"mode": "idle"}).collect()
    assert len(r) == 1 and r[0].increase == 20.0 + 5.0 + 3.0     # reset to 5 counts as +5
    by = sm.counter_rate(s, 3600, metric="c", by=["mode"]).collect()
    assert {x["mode"] for x in by} == {"idle", "user"}
    inst = sm.instant(s, lookback_seconds=86400, metric="c", match={"mode": "idle"}).collect()
    assert [x.value for x in inst] == [8.0]


def test_large_transactions_are_not_shuffled_again(spark, monkeypatch):
    """Beyond a file per task slot the stored transactions are written as the join leaves them, in files of bounded size."""
    want = fx.build_tx(spark, SF_SMALL)
    monkeypatch.setattr(fx, "ROWS_PER_FILE", 300)
    monkeypatch.setattr(fx, "_STORED", {})
    plans = []
    monkeypatch.setattr(type(want), "repartition", lambda df, *a: plans.append(a) or df)
    got = fx.tx(spark, SF_SMALL)
    assert not plans
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
