"""Queries over labelled metric samples (Q1m-Q9m).

Input: ``metric_samples(metric string, labels map<string,string>, ts timestamp,
value double)`` plus an optional tie column.  A series is (metric, labels);
because a map cannot be a grouping key, the series key is the sorted entry
array of the label map.  The PromQL strings of the reference become
aggregations: instant lookups with ``max_by``, label filters, sums and
averages across series, counter increases with reset handling, and label
matching joins.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import previous_row


def series_key(labels: str = "labels") -> Column:
    return F.array_sort(F.map_entries(F.col(labels)))


def label(name: str, labels: str = "labels") -> Column:
    return F.col(labels).getItem(name)


def instant(samples: DataFrame, at=None, lookback_seconds: int = 300, tie: Sequence[str] = (),
            metric: str | None = None, match: dict[str, str] | None = None) -> DataFrame:
    """Q1m: latest sample of every series in (at - lookback, at].

    ``at`` defaults to the newest sample time (one scalar aggregate).  The
    time filter is a literal range, so it reaches the parquet scan.
    ``metric`` / ``match`` select a metric name and label values first.
    """
    samples = _select(samples, metric, match)
    if at is None:
        at = samples.agg(F.max("ts")).first()[0]
        if at is None:
            return samples.select("metric", "labels", "ts", "value").limit(0)
    lo = F.lit(at) - F.make_dt_interval(secs=F.lit(lookback_seconds))
    window = samples.where((F.col("ts") > lo) & (F.col("ts") <= F.lit(at)))
    order = F.struct(F.col("ts"), *[F.col(c) for c in tie])
    latest = (window.groupBy("metric", series_key().alias("_sk"))
              .agg(F.max_by(F.struct("ts", "value"), order).alias("_last")))
    return latest.select("metric", F.map_from_entries("_sk").alias("labels"),
                         F.col("_last.ts").alias("ts"), F.col("_last.value").alias("value"))


def instant_range(samples: DataFrame, start: int, end: int, step: int, lookback_seconds: int = 300, missing: float | None = 0.0,
                  tie: Sequence[str] = (), metric: str | None = None, match: dict[str, str] | None = None) -> DataFrame:
    """Q1m at many instants: (metric, labels, at, value) for the instants start, start + step, ... end (epoch
    seconds) and every series with a sample in (start - lookback, end].

    ``value`` is that of the latest sample in (at - lookback, at], or ``missing`` where there is none (null keeps
    the gap).  A sample answers the instants from its own time to the next sample of the series, with its value
    while it is within the lookback; so one lag over the samples and one explode give the whole grid,
    without a join of instants with samples.  Hour buckets spread a busy series over tasks."""
    d = _select(samples, metric, match).where((F.col("ts") > F.timestamp_seconds(F.lit(start - lookback_seconds)))
                                              & (F.col("ts") <= F.timestamp_seconds(F.lit(end))))
    us, back = F.unix_micros("ts"), [f"_tie{i}" for i in range(len(tie))]
    # the next sample is the previous one of the reversed order
    d = d.select("metric", series_key().alias("_sk"), "value", us.alias("_us"), (-us).alias("_back"), *[(-F.col(t)).alias(b) for t, b in zip(tie, back)])
    p = previous_row(d, ["metric", "_sk"], ["_back", *back], ["_us"], F.floor(F.col("_back") / 3_600_000_000))
    grid = lambda t: F.ceil((t - F.lit(start * 1_000_000)) / (step * 1_000_000))  # noqa: E731  number of the first instant at or after t
    last = F.lit((end - start) // step).cast("bigint")
    first = F.greatest(grid(F.col("_us")), F.lit(0).cast("bigint"))
    until = F.when(F.col("prev__us").isNull(), last).otherwise(F.least(grid(F.col("prev__us")) - 1, last))
    none = F.array().cast("array<bigint>")
    held = p.select("metric", "_sk", "value", "_us", F.explode(F.when(first <= until, F.sequence(first, until)).otherwise(none)).alias("_k"))
    fresh = F.lit(start * 1_000_000) + F.col("_k") * (step * 1_000_000) < F.col("_us") + lookback_seconds * 1_000_000
    gap = F.lit(missing).cast("double")
    held = held.select("metric", "_sk", "_k", F.when(fresh, F.col("value")).otherwise(gap).alias("value"))
    # instants before a series' first sample
    head = d.groupBy("metric", "_sk").agg(F.min("_us").alias("_us")).withColumn("_n", F.least(grid(F.col("_us")) - 1, last)).where("_n >= 0")
    head = head.select("metric", "_sk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))).alias("_k"), gap.alias("value"))
    return held.unionByName(head).select("metric", F.map_from_entries("_sk").alias("labels"),
                                         F.timestamp_seconds(F.lit(start) + F.col("_k") * step).alias("at"), "value")


def pod_cpu_millicores(samples: DataFrame, window_seconds: int, tie: Sequence[str] = (), metric: str | None = None,
                       match: dict[str, str] | None = None) -> DataFrame:
    """Q8m: ``sum(rate(cpu seconds{match}[window])) * 1000`` per metric and window: each series' increase over the time it
    covers, so a pod that lived for a part of the window counts by that part."""
    r = counter_rate(samples, window_seconds, tie, metric, match, by=[])
    return r.select("metric", "window_start", (F.col("rate") * 1000).alias("cpu_millicores"))


def pod_mem_mib(inst: DataFrame, match: dict[str, str] | None = None) -> DataFrame:
    """Q8m: ``sum(working set bytes{match}) / 1048576`` over an instant vector, per metric."""
    return _select(inst, None, match).groupBy("metric").agg((F.sum("value") / 1048576).alias("mem_mib"),
                                                            F.count(F.lit(1)).cast("bigint").alias("n_series"))


def sum_by_label(inst: DataFrame, match: dict[str, str] | None = None, scale: float = 1.0,
                 by: Sequence[str] = ()) -> DataFrame:
    """Q2m/Q3m: ``sum(m{l="v"}) / scale`` -- plus avg and series count -- over
    an instant vector, per metric (and per ``by`` labels)."""
    d = inst
    for k, v in (match or {}).items():
        d = d.where(label(k) == F.lit(v))
    groups = ["metric", *[label(b).alias(b) for b in by]]
    return d.groupBy(*groups).agg(
        (F.sum("value") / scale).alias("sum_value"), F.avg("value").alias("avg_value"),
        F.count(F.lit(1)).cast("bigint").alias("n_series"))


def counter_increase(samples: DataFrame, window_seconds: int, tie: Sequence[str] = ()) -> DataFrame:
    """Q4m: per series and tumbling window [start, start + window), the counter
    increase and the time it covers.  Each step from one sample of the series
    to the next counts in the window of the later one, with its increase and
    its length, so nothing is lost between windows.  A decrease is a reset:
    the new value counts as the increase.  The first sample of a series has no
    step.  No extrapolation to the window edges (Prometheus does extrapolate;
    we do not claim its numbers).
    """
    w = F.floor(F.unix_seconds("ts") / window_seconds)
    d = samples.select("metric", series_key().alias("_sk"), "ts", "value", *tie, F.unix_micros("ts").alias("_us"))
    # hour buckets spread one busy series over several tasks
    p = previous_row(d, ["metric", "_sk"], ["ts", *tie], ["value", "_us"], F.floor(F.unix_seconds("ts") / 3600))
    inc = F.when(F.col("prev_value").isNull(), F.lit(0.0)).when(
        F.col("value") >= F.col("prev_value"), F.col("value") - F.col("prev_value")).otherwise(F.col("value"))
    return (p.withColumn("_w", w).groupBy("metric", "_sk", "_w")
            .agg(F.sum(inc).alias("increase"), F.count(F.lit(1)).cast("bigint").alias("n_samples"),
                 F.coalesce(F.sum(F.col("_us") - F.col("prev__us")), F.lit(0).cast("bigint")).alias("covered_us"))
            .select("metric", F.map_from_entries("_sk").alias("labels"),
                    F.timestamp_seconds(F.col("_w") * window_seconds).alias("window_start"),
                    "increase", "n_samples", "covered_us"))


def counter_rate(samples: DataFrame, window_seconds: int, tie: Sequence[str] = (), metric: str | None = None,
                 match: dict[str, str] | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """Q4m: ``rate(c[window])`` per series and window = increase / covered
    seconds (null where no time is covered); with ``by``, ``sum by (labels) (rate(...))``."""
    inc = counter_increase(_select(samples, metric, match), window_seconds, tie)
    rate = inc.withColumn("rate", F.try_divide(F.col("increase") * 1e6, F.col("covered_us").cast("double")))
    if by is None:
        return rate
    return rate.groupBy("metric", "window_start", *[label(b).alias(b) for b in by]).agg(F.sum("rate").alias("rate"))


def _select(samples: DataFrame, metric: str | None, match: dict[str, str] | None) -> DataFrame:
    d = samples if metric is None else samples.where(F.col("metric") == metric)
    for k, v in (match or {}).items():
        d = d.where(label(k) == F.lit(v))
    return d


def cpu_busy(increases: DataFrame, mode_label: str = "mode") -> DataFrame:
    """Q5m: per window, 100 - avg(rate(idle))*100, avg(rate(user))*100, avg(rate(iowait))*100.

    avg(rate) is taken over the covered time of all series, sum(increase) /
    sum(covered time): exact sums instead of a mean of already divided rates.
    """
    m = label(mode_label)

    def avg_rate(mode: str) -> Column:
        inc = F.sum(F.when(m == mode, F.col("increase")))
        covered = F.sum(F.when(m == mode, F.col("covered_us"))).cast("double")
        return F.try_divide(inc * 1e6, covered)

    return increases.groupBy("window_start").agg(
        (100 - avg_rate("idle") * 100).alias("busy_pct"),
        (avg_rate("user") * 100).alias("user_pct"),
        (avg_rate("iowait") * 100).alias("iowait_pct"))


def distinct_label_values(samples: DataFrame, name: str = "cpu") -> DataFrame:
    """Q6m: ``count(count(m) by (cpu))`` = number of distinct label values per metric."""
    return samples.groupBy("metric").agg(F.count_distinct(label(name)).cast("bigint").alias(f"n_{name}"))


def ratio_used_pct(inst: DataFrame, total_metric: str, avail_metric: str, on: Sequence[str]) -> DataFrame:
    """Q7m: ``(total - avail) / total * 100`` with vector matching ``on(labels)``:
    both sides are summed by the matching labels, then joined on them."""
    def side(m: str, name: str) -> DataFrame:
        return (inst.where(F.col("metric") == m)
                .groupBy(*[label(o).alias(o) for o in on]).agg(F.sum("value").alias(name)))
    j = side(total_metric, "total").join(side(avail_metric, "avail"), list(on))
    return j.select(*on, "total", "avail",
                    F.when(F.col("total") != 0, (F.col("total") - F.col("avail")) / F.col("total") * 100).alias("used_pct"))


def pct_of_max(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Q9m (F26): value as percent of the largest value of its group, capped at 100."""
    from ..functions.features import clamp_pct
    if not by:
        mx = df.agg(F.max(value)).first()[0]  # one scalar
        return df.withColumn("pct_of_max", clamp_pct(F.col(value), F.lit(mx).cast("double")))
    mx = df.groupBy(*by).agg(F.max(value).alias("_max"))
    j = df.join(mx, list(by))  # AQE broadcasts the measured aggregate where it is small
    return j.withColumn("pct_of_max", clamp_pct(F.col(value), F.col("_max"))).drop("_max")
