"""Exact k-th row search equals sorting, with ties and many rounds."""

import random

import pytest
from pyspark.sql import functions as F

from riskspark.operators import ml, selection
from riskspark.operators.risk import risk_concentration


@pytest.fixture
def tiny_bands(monkeypatch):
    monkeypatch.setattr(selection, "SMALL_BAND", 20)


def test_kth_cut_matches_sort(spark, tiny_bands):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 50), rnd.randint(0, 5), rnd.random()) for _ in range(2000)]
    rows += [(7, 1, 0.5)] * 300                       # one hot, fully tied key
    df = spark.createDataFrame(rows, "a long, b long, c double")
    ordered = sorted(rows)
    for k in (1, 17, 500, 1200, 1850, 2300):
        cut = selection.kth_cut(df, ["a", "b", "c"], k, accuracy=50)
        assert cut.key == ordered[k - 1]
        below = sum(1 for r in rows if r < cut.key)
        assert below + cut.take == k
        assert 1 <= cut.take <= sum(1 for r in rows if r == cut.key)


@pytest.mark.parametrize("band", [20, 50_000])
def test_kth_cut_with_nulls_and_nan(spark, monkeypatch, band):
    """Nulls first, NaN last, on the driver and by search alike; the cut splits the rows by Spark's own comparison."""
    monkeypatch.setattr(selection, "SMALL_BAND", band)
    rnd = random.Random(8)
    rows = [(rnd.choice([None, None, 1, 2, 3]), rnd.choice([None, float("nan"), 0.5, -1.0, rnd.random()])) for _ in range(900)]
    df = spark.createDataFrame(rows, "a long, b double")
    ordered = sorted(rows, key=selection._order)
    for k in (1, 60, 300, 451, 700, 899, 900):
        cut = selection.kth_cut(df, ["a", "b"], k, accuracy=50)
        assert selection._order(cut.key) == selection._order(ordered[k - 1])
        below = df.where(selection.below_cut(df, ["a", "b"], cut)).count()
        assert below + cut.take == k
        assert df.where(selection.at_cut(df, ["a", "b"], cut)).count() >= cut.take
        assert df.where(selection.upto_cut(df, ["a", "b"], cut)).count() >= k


def test_unscored_rows_are_in_no_top_share(spark):
    rows = [(None, 1, 1, 900.0), (0.9, None, 2, 10.0), (0.8, 3, 3, 30.0), (None, None, None, None), (0.1, 5, 5, 60.0)]
    df = spark.createDataFrame(rows, "fraud_score double, unix_time long, trans_key long, amt double")
    got = risk_concentration(df.withColumn("amt", F.col("amt").cast("decimal(18,2)")), p=0.2).first()
    assert (got.top_count, got.top_fraud_amount, got.fraud_amount) == (1, 10.0, 40.0)


def test_split_with_null_times(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else i, i) for i in range(100)], "unix_time long, id long")
    train, test = ml.ordered_split(df, 0.2)
    assert (train.count(), test.count()) == (80, 20)
    assert {r.id for r in test.collect()} == set(sorted(i for i in range(100) if i % 4)[-20:])


def test_risk_concentration_against_brute_force(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([0.1, 0.55, 0.9, 0.99]), rnd.randint(0, 50), i, float(rnd.randint(1, 9000)) / 100)
            for i in range(1500)]
    df = spark.createDataFrame(rows, "fraud_score double, unix_time long, trans_key long, amt double")
    got = risk_concentration(df.withColumn("amt", F.col("amt").cast("decimal(18,2)")), p=0.05).first()
    k = int(len(rows) * 0.05)
    top = sorted(rows, key=lambda r: (-r[0], -r[1], -r[2], -r[3]))[:k]
    want_top = round(sum(r[3] for r in top if r[0] >= 0.52), 2)
    assert got.top_count == k
    assert abs(got.top_fraud_amount - want_top) < 1e-6
