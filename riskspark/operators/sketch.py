"""A mergeable quantile sketch kept as counters of the metric store (A28's latency).

A value falls into the bucket i with GAMMA^(i-1) < value <= GAMMA^i.  A bucket is a counter named
``<name>_bucket_<i>``; values of 0 and less share ``<name>_bucket_zero``.  Counters of different batches, streams or
stores add up, so the fold of the store merges the sketch, and a compacted store holds it as well.  Any
quantile is within ``ACCURACY`` of a value of its rank.  There are few buckets: 1,400 from a nanosecond to a day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counters import VALUE

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
ZERO = "zero"


def sketch_rows(df: DataFrame, value: str, name: str, batch: str = "batch_id", ts: str = "batch_ts") -> DataFrame:
    """Metric rows of the buckets of each batch; null, NaN and infinite values have none."""
    v = F.col(value).cast("double")
    bucket = F.when(v <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(v) / math.log(GAMMA)).cast("string"))
    d = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    g = d.groupBy(F.col(batch).cast("bigint").alias("batch_id"), bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("ts"))
    return g.select("batch_id", F.concat(F.lit(f"{name}_bucket_"), "b").alias("name"), F.lit("counter").alias("kind"),
                    F.col("n").cast(VALUE).alias("value"), "ts")


def sketch_quantiles(folded: DataFrame, name: str, quantiles: dict[str, float]) -> DataFrame:
    """One row with a column per quantile (null without values) and ``n``, from folded counters.

    The value of rank ceil(q n) is given as the middle of its bucket.  The window runs over the buckets."""
    mark = f"{name}_bucket_"
    b = folded.where((F.col("kind") == "counter") & F.col("name").startswith(mark)).select(
        F.substring(F.col("name"), len(mark) + 1, 20).alias("b"), F.col("value").cast("bigint").alias("n"))
    index = F.when(F.col("b") == ZERO, None).otherwise(F.col("b").try_cast("int"))
    # one partition: it holds the buckets, whose number has a bound
    w = Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_first("i")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    run = b.select(index.alias("i"), "n").withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(every))
    middle = F.when(F.col("i").isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("i")) / (GAMMA + 1))

    def at(q: float) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(F.col("all") * q))
        return F.min(F.when(F.col("upto") >= rank, F.struct("upto", middle.alias("v"))))["v"]

    return run.agg(*[at(q).alias(c) for c, q in quantiles.items()], F.coalesce(F.max("all"), F.lit(0)).cast("bigint").alias("n"))
