"""Bucketed per-key windows equal plain windows, also for one hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.operators.series import cumulative, last_n_points
from riskspark.operators.smoothing import ema
from riskspark.operators.windows import previous_row, trailing_aggregate, trailing_sums


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < 0.6 else rnd.randint(1, 5)      # key 0 holds most rows
        rows.append((key, rnd.randint(0, 200_000), i, float(rnd.randint(-50, 500))))
    return spark.createDataFrame(rows, "k long, t long, id long, v double")


def test_trailing_aggregate_matches_range_window(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-3600, 0)
    want = df.select("id", F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("s"))
    got = trailing_aggregate(df, ["k"], "t", 3600,
                             {"n": lambda w: F.count(F.lit(1)).over(w), "s": lambda w: F.sum("v").over(w)},
                             bucket=5000).select("id", "n", "s")
    assert sorted(got.collect()) == sorted(want.collect())


def test_trailing_sums_match_range_window(spark):
    """Also for values and times that are null and for buckets as narrow as the span."""
    df = _data(spark).unionByName(_data(spark, 900, 3).withColumn("v", F.lit(None).cast("double")).withColumn("id", F.col("id") + 10_000))
    df = df.withColumn("t", F.when(F.col("id") % 97 != 0, F.col("t"))).withColumn("k", F.when(F.col("k") != 3, F.col("k")))
    df = df.withColumn("v", F.col("v").cast("decimal(18,2)"))
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-3600, 0)
    want = df.select("id", F.count(F.lit(1)).over(w).alias("n"), F.sum("v").over(w).alias("s"))
    for bucket in (3600, 5000, None):
        got = trailing_sums(df, ["k"], "t", 3600, {"n": F.lit(1).cast("bigint"), "s": F.col("v")}, bucket=bucket).select("id", "n", "s")
        assert sorted(got.collect()) == sorted(want.collect())


def test_trailing_aggregate_excluding_current(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-100, -1)
    want = df.select("id", F.max("id").over(w).alias("m"))
    got = trailing_aggregate(df, ["k"], "t", 100, {"m": lambda w: F.max("id").over(w.rangeBetween(-100, -1))},
                             bucket=250).select("id", "m")
    assert sorted(got.collect()) == sorted(want.collect())


def test_previous_row_matches_lag(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.lag("v").over(w).alias("prev_v"), F.lag("t").over(w).alias("prev_t"))
    got = previous_row(df, ["k"], ["t", "id"], ["v", "t"], F.floor(F.col("t") / 1000)).select("id", "prev_v", "prev_t")
    assert sorted(got.collect()) == sorted(want.collect())


def test_cumulative_max_and_sum(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    for how, fn in (("max", F.max), ("sum", F.sum), ("min", F.min)):
        want = df.select("id", fn("v").over(w).alias("r"))
        got = cumulative(df, ["k"], ["t", "id"], "v", how, bucket=F.floor(F.col("t") / 777), name="r").select("id", "r")
        assert sorted(got.collect()) == sorted(want.collect()), how


def test_last_n_points_matches_row_number(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy(F.col("t").desc(), F.col("id").desc())
    want = df.withColumn("pos", F.row_number().over(w)).where("pos <= 7").select("id", "pos")
    got = last_n_points(df, ["k"], ["t", "id"], 7).select("id", "pos")
    assert sorted(got.collect()) == sorted(want.collect())


def test_ema_reset_rule(spark):
    rows = [("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 100_000.0), ("a", 4, 100_010.0), ("b", 1, 5.0)]
    df = spark.createDataFrame(rows, "s string, t long, x double")
    got = {(r.s, r.t): r.ema for r in ema(df, ["s"], ["t"], "x").collect()}
    e1 = 0.0 * 0.7 + 10.0 * 0.3
    e2 = e1 * 0.7 + 20.0 * 0.3
    assert got[("a", 1)] == e1 and got[("a", 2)] == e2
    assert got[("a", 3)] == 100_000.0                      # jump > 50000 resets to the value
    assert got[("a", 4)] == 100_000.0 * 0.7 + 100_010.0 * 0.3
    assert got[("b", 1)] == 5.0 * 0.3
