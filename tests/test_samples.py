"""Samples at many instants, pod rates, quantities, the exact head and the quantile sketch against brute force."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from riskspark.functions import text as tx
from riskspark.operators import counters as ct
from riskspark.operators import samples as sm
from riskspark.operators import sketch
from riskspark.sources import readers as rd

SAMPLES = "metric string, labels map<string,string>, ts timestamp, value double, event_id long"
T0 = 1_700_000_000


def at(seconds):
    return datetime.fromtimestamp(T0 + seconds, timezone.utc).replace(tzinfo=None)


@pytest.mark.parametrize("missing", [0.0, None])
def test_instants_of_a_hot_and_of_sparse_series(spark, missing):
    rng = random.Random(1)
    rows = [("m", {"s": "hot"}, at(rng.uniform(-900, 9000)), float(i), i) for i in range(3000)]
    rows += [("m", {"s": f"rare{i % 4}"}, at(rng.uniform(-900, 9000)), float(i), 10_000 + i) for i in range(17)]
    rows += [("m", {"s": "tie"}, at(600), 1.0, 2), ("m", {"s": "tie"}, at(600), 5.0, 9), ("m", {"s": "old"}, at(-1000), 1.0, 1),
             ("m", {"s": "edge"}, at(300), 7.0, 3), ("m", {"s": "late"}, at(8000), 7.0, 4), ("n", {}, at(0), 3.0, 5)]
    df = spark.createDataFrame(rows, SAMPLES)
    start, end, step, lookback = T0, T0 + 7300, 60, 300
    got = {(r.metric, tuple(r.labels.items()), r.s): r.value for r in sm.instant_range(
        df, start, end, step, lookback, missing, tie=["event_id"]).withColumn("s", F.unix_seconds("at")).collect()}
    want = {}
    epoch = lambda t: t.replace(tzinfo=timezone.utc).timestamp()
    for metric, labels in {(m, tuple(l.items())) for m, l, t, _, _ in rows if start - lookback < epoch(t) <= end}:
        own = [(epoch(t), i, v) for m, l, t, v, i in rows if m == metric and tuple(l.items()) == labels]
        for t in range(start, end + 1, step):
            seen = [x for x in own if t - lookback < x[0] <= t]
            want[metric, labels, t] = max(seen)[2] if seen else missing
    assert got == want
    assert sm.instant_range(df.limit(0), start, end, step).count() == 0


def test_pod_rate_counts_the_covered_time(spark):
    """A pod that lived one hour of the day at one core counts one core, not a 24th."""
    rows = [("cpu", {"pod": "a", "namespace": "x"}, at(3600 * h - T0 % 86400), 3600.0 * h, h) for h in (10, 11)]
    rows += [("cpu", {"pod": "b", "namespace": "y"}, at(3600 * h - T0 % 86400), 1800.0 * h, 50 + h) for h in range(1, 24)]
    df = spark.createDataFrame(rows, SAMPLES)
    assert [r.cpu_millicores for r in sm.pod_cpu_millicores(df, 86400).collect()] == [pytest.approx(1500.0)]
    assert [r.cpu_millicores for r in sm.pod_cpu_millicores(df, 86400, match={"namespace": "x"}).collect()] == [pytest.approx(1000.0)]
    assert [r.mem_mib for r in sm.pod_mem_mib(df, {"pod": "b"}).collect()] == [pytest.approx(sum(1800.0 * h for h in range(1, 24)) / 1048576)]


def test_quantity_units(spark):
    cases = {"5": (5 * 1024, 5), "5Ki": (5120, 1), "5ki": (5120, 1), "5k": (5000, 1), "5K": (5000, 1), "3Mi": (3 << 20, 1), "3m": (3_000_000, 1),
             "2Gi": (2 << 30, 2), "2G": (2_000_000_000, 1), "1ti": (1 << 40, 1024), "1T": (10 ** 12, 931), "0Gi": (0, 1), "": (None, None),
             "x": (None, None), "1.5Gi": (None, None), "5 Gi": (None, None), "9" * 18 + "Ti": (None, None), None: (None, None), "5KiB": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    got = {r.q: (r.b, r.g) for r in df.select("q", tx.memory_bytes(F.col("q")).alias("b"), tx.memory_gib(F.col("q")).alias("g")).collect()}
    assert got == cases


@pytest.mark.parametrize("n", [0, 1, 700, 1999, 2000, 5000])
def test_sample_limit_is_the_sorted_head(spark, n, monkeypatch):
    from riskspark.operators import selection
    monkeypatch.setattr(selection, "SMALL_BAND", 50)
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(6)]), float(rng.randrange(4)), rng.choice(["a", "b", None])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "t long, v double, s string").repartition(5)
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r[:2]) + ((r[2] is not None, r[2] or ""),)
    want = sorted(rows, key=key)[:n]
    got = sorted((tuple(r) for r in rd.sample_limit(df, n, ["t", "v", "s"]).collect()), key=key)
    assert got == want


def test_quantile_sketch_merges_through_the_store(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(2, 1.5) for _ in range(4000)] + [0.0, -1.0, 1e-9, 5e7]
    rows = [(i % 7, v, datetime(2024, 1, 1) + timedelta(days=i % 7)) for i, v in enumerate(values)]
    rows += [(1, None, None), (1, float("nan"), None), (1, float("inf"), None)]
    df = spark.createDataFrame(rows, "batch_id long, v double, batch_ts timestamp")
    folded = ct.metric_fold(sketch.sketch_rows(df, "v", "lat"))
    q = {f"q{i}": p for i, p in enumerate([0.0, 0.01, 0.5, 0.9, 0.99, 1.0])}
    got = sketch.sketch_quantiles(folded, "lat", q).first()
    assert got.n == len(values)
    values.sort()
    for c, p in q.items():
        exact = max(values[max(1, math.ceil(p * len(values))) - 1], 0.0)
        assert abs(got[c] - exact) <= sketch.ACCURACY * exact * 1.000001
    none = sketch.sketch_quantiles(folded, "other", q).first()
    assert none.n == 0 and none.q2 is None
