"""Series operators over metric points (W1-W8; smoothing, W3, is in ``smoothing``).

A series is identified by ``keys``; points are ordered by a time column and
a tie column.  Deltas use the bucketed ``previous_row`` and running values
use the bucketed ``cumulative`` so that one long series is spread over many
tasks; only per-bucket summaries are ordered per series.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import null_safe_join, previous_row

MIB = 1024 * 1024


def day_bucket(time_col: str) -> Column:
    """Default bucket of a timestamp column: its UTC day."""
    return F.floor(F.unix_seconds(F.col(time_col)) / 86400)


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds (double, microsecond precision)."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def with_previous(df: DataFrame, keys: Sequence[str], time: str, value: str,
                  tie: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Add ``prev_<time>``, ``prev_<value>`` and ``dt`` (seconds since the previous point)."""
    out = previous_row(df, keys, [time, *tie], [time, value], bucket if bucket is not None else day_bucket(time))
    return out.withColumn("dt", seconds_between(F.col(f"prev_{time}"), F.col(time)))


def rate_delta(df: DataFrame, keys: Sequence[str], time: str, value: str, min_dt: float = 0.1,
               tie: Sequence[str] = ()) -> DataFrame:
    """(value - previous) / dt per series, only when dt > min_dt seconds."""
    p = with_previous(df, keys, time, value, tie)
    return p.withColumn("rate", F.when(F.col("dt") > min_dt, (F.col(value) - F.col(f"prev_{value}")) / F.col("dt")))


def velocity_per_min(df: DataFrame, keys: Sequence[str], time: str, value: str, min_dt: float = 0.1,
                     tie: Sequence[str] = ()) -> DataFrame:
    """max(0, delta) / dt * 60 per series (events per minute)."""
    p = with_previous(df, keys, time, value, tie)
    d = F.greatest(F.lit(0.0), (F.col(value) - F.col(f"prev_{value}")).cast("double"))
    return p.withColumn("per_min", F.when(F.col("dt") > min_dt, d / F.col("dt") * 60))


def byte_growth(df: DataFrame, keys: Sequence[str], time: str, nbytes: str, tie: Sequence[str] = ()) -> DataFrame:
    """max(0, delta bytes) / 2^20 / dt  (MiB/s) per volume; 0 without a positive dt."""
    p = with_previous(df, keys, time, nbytes, tie)
    d = F.greatest(F.lit(0.0), (F.col(nbytes) - F.col(f"prev_{nbytes}")).cast("double"))
    return p.withColumn("mib_per_s", F.when(F.col("dt") > 0, d / MIB / F.col("dt")).otherwise(F.lit(0.0)))


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, how: str = "max",
               bucket: Column | None = None, name: str | None = None) -> DataFrame:
    """W6 and running sums: running ``max``/``min``/``sum`` of ``value`` per series in ``order``.

    Running value = combine(value over earlier buckets, running value inside
    the bucket).  The first part is a running aggregate over the per-bucket
    summary, so a long series is not sorted in one task.
    """
    keys, order = list(keys), list(order)
    name = name or f"running_{how}"
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    b = bucket if bucket is not None else day_bucket(order[0])
    d = df.withColumn("_b", b)
    w_in = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = d.withColumn("_in", agg(value).over(w_in))
    per_bucket = d.groupBy(*keys, "_b").agg(agg(value).alias("_tot"))
    w_b = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select(*keys, "_b", agg("_tot").over(w_b).alias("_before"))
    j = null_safe_join(inside, before, [*keys, "_b"])
    if how == "sum":
        combined = F.coalesce(F.col("_before") + F.col("_in"), F.col("_in"), F.col("_before"))
    elif how == "max":
        combined = F.greatest(F.col("_before"), F.col("_in"))
    else:
        combined = F.least(F.col("_before"), F.col("_in"))
    return j.withColumn(name, combined).drop("_b", "_in", "_before")


def monotone_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Counters never go down -- running maximum per series."""
    return cumulative(df, keys, order, value, "max", name="monotone")


def last_n_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 60) -> DataFrame:
    """Newest ``n`` points per series, with ``pos`` 1 = newest.

    The filter on ``row_number`` becomes a group limit that every task applies
    before the shuffle, so a series sends at most ``n`` points per task.
    ``order`` must be a total order (add a tie column).
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def combine_sources(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """Merge two sources of one measure per tick: ``combined`` = the larger
    of the two, ``first_non_null`` = source a, else source b."""
    a2 = a.select(*on, F.col(value).alias("a_value"))
    b2 = b.select(*on, F.col(value).alias("b_value"))
    j = a2.join(b2, list(on), "full_outer")
    return j.select(*on, "a_value", "b_value", F.greatest("a_value", "b_value").alias("combined"),
                    F.coalesce("a_value", "b_value").alias("first_non_null"))
