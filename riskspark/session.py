"""Spark session settings shared by the library, the tests and the bench.

Everything here is plain SparkSession configuration: UTC session time zone,
ANSI mode (Spark 4 default, kept explicit), adaptive query execution with
partition coalescing and skew handling, and no web UI.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, app: str = "riskspark",
                shuffle_partitions: int | None = None,
                driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    ``master`` defaults to ``local[$BENCH_CPUS or *]`` only when no master is
    configured by the environment, so the same code runs under spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    if master is None and "SPARK_MASTER" not in os.environ and not os.environ.get("PYSPARK_SUBMIT_ARGS"):
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared folder and is only read.  When it is
    unset, a local master gets a fresh scratch folder and any other master an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="riskspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint_path(spark: SparkSession, *parts: str) -> str:
    """A sub-folder of the shared checkpoint folder (for streaming checkpoints
    and written intermediate tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])


@contextmanager
def conf_override(spark: SparkSession, key: str, value: str):
    """Set a SQL conf for the duration of a block, then restore it."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def state_partitions(spark: SparkSession) -> str:
    """State-store partitions for a new stateful stream: one per task slot.

    The count is fixed in the checkpoint at the first start, so it is chosen
    from the cluster's parallelism rather than the batch shuffle setting."""
    return str(max(1, spark.sparkContext.defaultParallelism))
