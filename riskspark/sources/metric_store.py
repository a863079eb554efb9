"""The metric store on disk (S14, X5): idempotent batches, compacted into a base with a high-water mark.

Layout of a store's folder:

* ``batch_id=<n>/`` rows of one micro-batch; writing the batch again replaces it;
* ``_base/upto=<h>/`` all batches up to h, folded to one row per name and kind;
* ``_history/upto=<h>/`` the rows of the batches that one compaction closed, in few files.

The newest finished ``upto=<h>`` is the manifest: readers take that base and the batches above h.  A batch at or
below h is in the base; writing it again changes nothing.  A compaction writes the new base beside the old
one and becomes visible by its commit marker alone.  What it replaces is removed by the compaction after
it, so a reader that listed the folder just before still finds its files, and a compaction that broke off is
simply run again.  So a store holds the batches of at most two compactions, two bases, and few history files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders

#: Names and rows: a value of a counter or gauge in a batch, ``n`` being the batch rows it stands for.
SCHEMA = "name string, kind string, value decimal(38,6), ts timestamp, n bigint, batch_id bigint"
ROWS_PER_FILE = 5_000_000


def high_water(spark: SparkSession, path: str) -> int | None:
    """The last batch in the base (None: nothing is compacted yet)."""
    done = folders.numbers(spark, f"{path}/_base", "upto")
    return done[-1] if done else None


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows, one folder per ``batch_id``, replaced as a whole when a batch is written again.
    Batches that are in the base already are left out."""
    closed = high_water(metrics.sparkSession, path)
    rows = metrics if closed is None else metrics.where(F.col("batch_id") > closed)
    # the rows of a batch are as many as there are names: one file each
    (rows.repartition("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "snappy").partitionBy("batch_id").parquet(path))


def _batches(spark: SparkSession, path: str, above: int | None, upto: int | None = None) -> DataFrame:
    """Rows of the batch folders above ``above`` and up to ``upto``; only those folders are listed further."""
    wanted = [b for b in folders.numbers(spark, path, "batch_id", finished=False)
              if (above is None or b > above) and (upto is None or b <= upto)]
    if not wanted:
        return spark.createDataFrame([], SCHEMA)
    try:
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch_id={b}" for b in wanted])
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # only folders without a file
            raise
        return spark.createDataFrame([], SCHEMA)
    return rows.select("name", "kind", F.col("value").cast("decimal(38,6)").alias("value"), "ts", F.lit(1).cast("bigint").alias("n"),
                       F.col("batch_id").cast("bigint").alias("batch_id"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """S15's input: the base and the batches above it (``counters.metric_fold`` takes it as it is)."""
    closed = high_water(spark, path)
    rows = _batches(spark, path, closed)
    if closed is None:
        return rows
    return spark.read.schema(SCHEMA).parquet(f"{path}/_base/upto={closed}").unionByName(rows)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Every row ever written, one per batch, name and kind: closed batches and open ones."""
    closed = folders.numbers(spark, f"{path}/_history", "upto")
    rows = _batches(spark, path, closed[-1] if closed else None)
    for upto in closed[:1]:
        rows = spark.read.schema(SCHEMA).parquet(*[f"{path}/_history/upto={h}" for h in closed]).unionByName(rows)
    return rows


def fold_rows(rows: DataFrame) -> DataFrame:
    """Rows of one name and kind as one row that folds on like them: counters add up, the newest gauge stays."""
    newest = F.max(F.struct("ts", "batch_id", "value"))
    return rows.groupBy("name", "kind").agg(
        F.when(F.col("kind") == "counter", F.sum("value")).otherwise(newest["value"]).cast("decimal(38,6)").alias("value"),
        newest["ts"].alias("ts"), F.sum("n").alias("n"), newest["batch_id"].alias("batch_id"))


def compact_metrics(spark: SparkSession, path: str, upto: int) -> None:
    """Close all batches up to ``upto`` (which the stream has committed): fold them into the base.

    Running it again, or with a batch that is closed already, changes nothing."""
    closed = high_water(spark, path)
    if closed is not None and upto <= closed:
        return
    fresh = _batches(spark, path, closed, upto)
    files = max(1, -(-fresh.count() // ROWS_PER_FILE))
    if upto not in folders.numbers(spark, f"{path}/_history", "upto"):
        fresh.repartition(files).write.mode("overwrite").parquet(f"{path}/_history/upto={upto}")
    base = fresh if closed is None else spark.read.schema(SCHEMA).parquet(f"{path}/_base/upto={closed}").unionByName(fresh)
    fold_rows(base).repartition(1 if closed is None else files).write.mode("overwrite").parquet(f"{path}/_base/upto={upto}")
    if closed is not None:  # what the compaction before this one had replaced
        for b in folders.numbers(spark, path, "batch_id", finished=False):
            if b <= closed:
                folders.remove(spark, f"{path}/batch_id={b}")
        for h in folders.numbers(spark, f"{path}/_base", "upto", finished=False):
            if h < closed:
                folders.remove(spark, f"{path}/_base/upto={h}")
