"""Smoothing with reset, split by speculation, is bit for bit the sequential fold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskspark.operators import smoothing as sm


def sequential(points, alpha=0.3, reset=50_000.0, start=0.0):
    old, out = start, []
    for v in points:
        if v is not None and v == v:
            old = v if abs(v - old) > reset else old * (1.0 - alpha) + v * alpha
        out.append(old)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_every_start(seed):
    rng = random.Random(seed)
    reset = rng.choice([1.0, 50.0, 50_000.0, 0.0, 5e4])
    scale = rng.choice([0.1, 1, 3, 100])
    values = [rng.choice([0.0, reset, -reset, rng.gauss(0, scale * reset + 1), float("nan")]) for _ in range(rng.choice([1, 3, 40, 200]))]
    lo, hi = sm.fold_bounds(values, -math.inf, math.inf, 0.3, reset)
    starts = [-1e300, 1e300, 0.0, *[rng.gauss(0, 3 * scale * reset + 1) for _ in range(300)]]
    starts += [v + s * reset * (1 + d) for v in values[:3] if v == v for s in (-1, 1) for d in (0, 2e-16, -2e-16, 5e-16)]
    for s in starts:
        assert lo <= sm.fold(values, s, 0.3, reset) <= hi


def test_floats_between():
    assert sm.floats_between(1.0, 1.0, 4) == [1.0]
    assert sm.floats_between(-5e-324, 5e-324, 4) == [-5e-324, 0.0, 5e-324]
    assert sm.floats_between(1.0, 2.0, 64) is None and sm.floats_between(-math.inf, 1.0, 64) is None
    assert sm.floats_between(-1.0, math.nextafter(-1.0, 0), 4) == [-1.0, math.nextafter(-1.0, 0)]


def far_apart(n):
    """Values at which some starts reset and others do not, again and again: bounds never meet."""
    out, a, b = [], 0.0, 60_000.0
    for _ in range(n):
        v = a + 49_000 if b - a > 30_000 else (a + b) / 2 + 50_000
        out.append(v)
        a, b = (sm.fold([v], s, 0.3, 50_000.0) for s in (a, b))
    return out


def series_cases():
    rng = random.Random(4)
    walk = [rng.gauss(0, 20_000) for _ in range(4000)]
    resets = [rng.choice([0.0, 200_000.0, -300_000.0]) if i % 50 == 0 else rng.gauss(0, 1000) for i in range(4000)]
    return {"one": walk, "resets": resets, "constant": [0.1 + 0.2] * 4000, "zero": [0.0] * 4000, "far": far_apart(600),
            "gaps": [None if i % 3 else rng.gauss(0, 60_000) for i in range(1500)], "nan": [float("nan")] * 900,
            "short": [1.0], "steps": [60_000.0 * (i % 2) for i in range(2000)], "inf": [math.inf, 1.0, -math.inf, 2.0] * 200}


@pytest.mark.parametrize("case", sorted(series_cases()))
def test_one_series_over_many_parts(spark, case):
    """One series holds all rows; parts end anywhere, also at resets."""
    points = series_cases()[case]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(points)], "k string, t long, x double").repartition(5)
    got = [r.ema for r in sm.ema(df, ["k"], ["t"], "x", parts=13).orderBy("t").collect()]
    assert [repr(v) for v in got] == [repr(v) for v in sequential(points)]


def test_many_series_with_starting_values(spark):
    rows, want = [], {}
    for j, (name, points) in enumerate(sorted(series_cases().items())):
        for key in (f"{name}", None if j == 3 else f"{name}-2"):
            start = 1000.0 * j
            for i, (v, e) in enumerate(zip(points, sequential(points, start=start if key else 0.0))):
                rows.append((key, j if key else None, i, v))
                want[key, i] = repr(e)
    df = spark.createDataFrame(rows, "k string, j int, t long, x double")
    start = df.where("k is not null").groupBy("k", "j").agg((F.first("j") * 1000.0).alias("ema"))
    for parts in (1, 7):
        got = sm.ema(df, ["k", "j"], ["t"], "x", start=start, parts=parts).collect()
        assert len(got) == len(rows) and all(repr(r.ema) == want[r.k, r.t] for r in got)
    assert sm.ema(df.limit(0), ["k", "j"], ["t"], "x").count() == 0
