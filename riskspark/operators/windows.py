"""Skew-tolerant building blocks for per-key ordered windows.

A window ``partitionBy(key)`` sends every row of one key to one task.  When a
single card, series or log holds a large share of the rows, that task is the
whole job.  The helpers here add a time (or line) bucket to the partition key
and make each bucket self-sufficient:

* ``trailing_aggregate`` -- aggregates over a trailing span (``rangeBetween``).
  Rows closer than ``span`` to the next bucket are copied into it as context
  rows, which the frame sees but which are not emitted.  Exact for any span
  up to the bucket width.
* ``trailing_sums`` -- the same frame for sums and counts, which can be taken
  back: a row adds its value at its time and subtracts it after the span, so
  one running sum per bucket gives the result whatever the span.
* ``previous_row`` -- ``lag`` by one row.  Inside a bucket a windowed ``lag``;
  for the first row of a bucket the last row of the nearest earlier non-empty
  bucket, found on the per-bucket summary (one row per key and bucket).
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def trailing_aggregate(df: DataFrame, keys: Sequence[str], order: str, span: int,
                       aggs: dict[str, Callable[[WindowSpec], Column]], bucket: int | None = None) -> DataFrame:
    """Add ``aggs`` evaluated over rows of the same ``keys`` with
    ``order`` in [order - span, order] (peers included, like RANGE frames).
    Each value of ``aggs`` maps the window spec to a column, e.g.
    ``lambda w: F.count(F.lit(1)).over(w)``.

    ``order`` must be an integral column (epoch seconds, line numbers).
    ``bucket`` (default 24 spans) is the width of the partitioning bucket.
    """
    width = bucket or span * 24
    if width < span:
        raise ValueError("bucket must be at least the span")
    t = F.col(order)
    b = F.floor(t / width)
    near_next = t >= (b + 1) * width - span
    home = F.struct(b.alias("b"), F.lit(True).alias("own"))
    ctx = F.struct((b + 1).alias("b"), F.lit(False).alias("own"))
    exploded = df.withColumn("_bk", F.explode(F.when(near_next, F.array(home, ctx)).otherwise(F.array(home))))
    exploded = exploded.withColumn("_b", F.col("_bk.b")).withColumn("_own", F.col("_bk.own")).drop("_bk")
    w = Window.partitionBy(*keys, "_b").orderBy(t).rangeBetween(-span, 0)
    out = exploded.select("*", *[agg(w).alias(name) for name, agg in aggs.items()])
    return out.where(F.col("_own")).drop("_b", "_own")


def trailing_sums(df: DataFrame, keys: Sequence[str], order: str, span: int,
                  sums: dict[str, Column], bucket: int | None = None) -> DataFrame:
    """``trailing_aggregate`` for exact sums (integral or decimal columns): adds, per
    name, the sum of the column over ``order`` in [order - span, order], null
    where the frame holds no value.  The work per row does not depend on how
    many rows the span holds.  Rows without an order see each other only."""
    width = bucket or span * 24
    if width < span:
        raise ValueError("bucket must be at least the span")
    names = list(sums)
    d = df.select("*", *[c.alias(f"_v{i}") for i, c in enumerate(sums.values())])
    t = F.col(order)
    b = F.floor(t / width)
    end = (b + 1) * width

    def event(bucket_: Column, at: Column, sign: int, own: bool) -> Column:
        return F.struct(bucket_.alias("b"), at.cast("long").alias("t"), F.lit(sign).alias("sign"), F.lit(own).alias("own"))

    own = event(b, t, 1, True)
    leave = t + span + 1
    events = (F.when(leave < end, F.array(own, event(b, leave, -1, False)))
              .when(t >= end - span, F.array(own, event(b + 1, end, 1, False), event(b + 1, leave, -1, False)))
              .otherwise(F.array(own)))
    e = d.select("*", F.explode(events).alias("_e"))
    # entries and leavings carry only the key and the values through the shuffle
    row = F.when(F.col("_e.own"), F.struct(*df.columns)).alias("_row")
    e = e.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_e", row, *[f"_v{i}" for i in range(len(names))])
    w = (Window.partitionBy(*[f"_g{i}" for i in range(len(keys))], "_e.b").orderBy("_e.t")
         .rangeBetween(Window.unboundedPreceding, 0))
    sign = F.col("_e.sign")
    out = []
    for i, name in enumerate(names):
        v = F.col(f"_v{i}")
        held = F.sum(F.when(v.isNotNull(), sign).otherwise(F.lit(0))).over(w)
        out.append(F.when(held > 0, F.sum(F.when(sign > 0, v).otherwise(-v)).over(w)).alias(name))
    res = e.select("_row", *out).where(F.col("_row").isNotNull())
    return res.select("_row.*", *names)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys equal each other; the right side's keys are dropped."""
    names = {c: f"_r_{c}" for c in on}
    cond = F.lit(True)
    for c, r in names.items():
        cond = cond & F.col(c).eqNullSafe(F.col(r))
    return left.join(right.withColumnsRenamed(names), cond, how).drop(*names.values())


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                 bucket_col: Column, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` for each ``c`` in ``cols``: the value of the previous row
    of the same ``keys`` in ``order`` (null for the first row of a key).

    ``bucket_col`` is a coarse, order-compatible bucket of the order (for
    example the day of a timestamp).  Its rows of one key are handled by
    separate tasks; only the per-bucket summary is ordered per key.
    """
    keys, order, cols = list(keys), list(order), list(cols)
    d = df.withColumn("_b", bucket_col)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    within = d.select("*", *[F.lag(c).over(w).alias(f"{prefix}{c}") for c in cols],
                      (F.row_number().over(w) == 1).alias("_first"))
    # last row of every (key, bucket): max_by over the ordering struct (partial aggregation)
    ordering = F.struct(*[F.col(o) for o in order])
    tails = d.groupBy(*keys, "_b").agg(F.max_by(F.struct(*[F.col(c) for c in cols]), ordering).alias("_tail"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    prev_tail = tails.select(*keys, "_b", F.lag("_tail").over(wb).alias("_ptail"))
    joined = null_safe_join(within, prev_tail, [*keys, "_b"])
    made = {f"{prefix}{c}" for c in cols}
    out = joined.select(
        *[F.col(c) for c in within.columns if c not in ("_first", "_b") and c not in made],
        *[F.when(F.col("_first"), F.col(f"_ptail.{c}")).otherwise(F.col(f"{prefix}{c}")).alias(f"{prefix}{c}")
          for c in cols])
    return out
