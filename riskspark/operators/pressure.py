"""Queue pressure, thresholds, node status and usage totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed value: the limit used for a topic without a critical limit.
DEFAULT_LIMIT = 5000
# Pressure levels (percent) and total cluster cores of the usage percentage.
CRITICAL_PCT, WARNING_PCT = 90, 70
CLUSTER_CORES = 41


def backlog(files: DataFrame, ledger: DataFrame, on=("file", "run"), unit: str = "files") -> DataFrame:
    """Unread files per topic = files not in the ledger (left anti join),
    counted as files or as rows (``unit``)."""
    pending = files.join(ledger, list(on), "left_anti")
    cnt = F.count(F.lit(1)) if unit == "files" else F.sum("rows")
    return pending.groupBy("topic").agg(cnt.cast("bigint").alias("count"))


def queue_pressure(backlogs: DataFrame, limits: DataFrame) -> DataFrame:
    """pressure = min(100, int(count / limit * 100)) with limit = the
    topic's critical limit (5000 when it has none); >= 90 Critical, >= 70
    Warning, else Normal.  The limits table has one row per topic."""
    lim = limits.select("topic", F.coalesce("critical", F.lit(DEFAULT_LIMIT)).alias("limit"))
    j = backlogs.join(lim, "topic", "left").withColumn("limit", F.coalesce("limit", F.lit(DEFAULT_LIMIT)).cast("bigint"))
    pct = F.when(F.col("limit") > 0, F.least(F.lit(100), F.floor(F.col("count") / F.col("limit") * 100))).otherwise(F.lit(0))
    j = j.withColumn("pressure_pct", pct.cast("int"))
    status = (F.when(F.col("pressure_pct") >= CRITICAL_PCT, "Critical")
               .when(F.col("pressure_pct") >= WARNING_PCT, "Warning").otherwise("Normal"))
    return j.select("topic", "count", "limit", "pressure_pct", status.alias("status"))


def threshold_action(backlogs: DataFrame, limits: DataFrame) -> DataFrame:
    """Level (critical / warning / ok) of each backlog against the topic's
    limits, with the action configured for the topic when a limit is hit."""
    j = backlogs.join(limits, "topic", "left")
    c = F.col("count")
    level = (F.when(F.col("critical").isNotNull() & (c >= F.col("critical")), "critical")
              .when(F.col("warning").isNotNull() & (c >= F.col("warning")), "warning").otherwise("ok"))
    return j.select("topic", "count", level.alias("level"),
                    F.when(level != "ok", F.col("action")).alias("action"))


def node_status(util: Column, gpu_util: Column | None = None, cpu_mbps: Column | None = None,
                gpu_mbps: Column | None = None) -> list[Column]:
    """Healthy below 90 % utilisation else Stressed; GPU above 80 % High
    Load; volume throughput above 50 (cpu) / 100 (gpu) MB/s High, else Low."""
    out = [F.when(util < 90, "Healthy").otherwise("Stressed").alias("node_status")]
    if gpu_util is not None:
        out.append(F.when(gpu_util > 80, "High Load").otherwise("Normal").alias("gpu_status"))
    if cpu_mbps is not None:
        out.append(F.when(cpu_mbps > 50, "High").otherwise("Low").alias("cpu_io_score"))
    if gpu_mbps is not None:
        out.append(F.when(gpu_mbps > 100, "High").otherwise("Low").alias("gpu_io_score"))
    return out


def io_efficiency(storage: DataFrame, usage: DataFrame, on: str = "tick") -> DataFrame:
    """MB/s per core used and per pod, 0 when there are no cores/pods.
    ``storage``: (tick, mbps); ``usage``: (tick, cores, pods).  Joined per tick."""
    j = storage.join(usage, on, "inner")
    return j.select(on, "mbps", "cores", "pods",
                    F.when(F.col("cores") > 0, F.col("mbps") / F.col("cores")).otherwise(F.lit(0.0)).alias("mbps_per_core"),
                    F.when(F.col("pods") > 0, F.col("mbps") / F.col("pods")).otherwise(F.lit(0.0)).alias("mbps_per_pod"))


def usage_totals(usage: DataFrame, cores: int = CLUSTER_CORES) -> DataFrame:
    """Millicores and MiB per app, and the app's share of the cluster's cores."""
    g = usage.groupBy("app").agg(
        F.sum("cpu_millicores").cast("bigint").alias("cpu_millicores"),
        F.sum("mem_mib").cast("bigint").alias("mem_mib"),
        F.count(F.lit(1)).cast("bigint").alias("pods"))
    return g.withColumn("cpu_pct", F.col("cpu_millicores") / (cores * 1000.0) * 100)
