"""Sinks (S10, S11, S19): snappy parquet, dual writes and JSON snapshots (metric batches: ``metric_store``)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folders


def write_parquet_snappy(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Parquet with snappy compression (Spark's commit protocol makes the
    files appear together or not at all)."""
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def dual_sink(df: DataFrame, path_a: str, path_b: str, batch_id: int | None = None) -> None:
    """Write one batch to two places (queue + archive), both with the same rows.  With ``batch_id`` each write goes to
    its own ``batch_id=`` folder and is overwritten on replay, and the second place gets what the first was given, read
    from there: the batch is computed once and no third copy of it is kept.  Without, the batch is persisted for both."""
    if batch_id is not None:
        _write_batch(df, path_a, batch_id)
        written = f"{path_a.rstrip('/')}/batch_id={batch_id}"
        if f"batch_id={batch_id}" in folders.names(df.sparkSession, path_a):  # a batch without rows has no folder
            _write_batch(df.sparkSession.read.schema(df.schema).parquet(written), path_b, batch_id)
        return
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for p in (path_a, path_b):
            write_parquet_snappy(df, p, "append")
    finally:
        df.unpersist(blocking=True)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy("batch_id").parquet(path))


def snapshot_json(df: DataFrame, path: str) -> None:
    """The latest payload (a small aggregate) as one JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
