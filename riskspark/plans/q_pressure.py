"""Queue pressure, thresholds, node status, I/O efficiency and usage totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import pressure as pr
from ..operators import samples as sm
from ..sources import fixtures as fx
from .catalog import register
from .q_samples import INCREASE, DAY
from .q_text import USAGE

BACKLOG = f"""files as ({fx.run_files_sql()}), ledger as ({fx.FILE_LEDGER_SQL}),
limits as ({fx.queue_limits_sql()}),
bl as (select topic, cast(sum(rows) as bigint) as count from files f
       where not exists (select 1 from ledger l where l.file = f.file and l.run = f.run) group by topic)"""


def _backlog(spark, sf):
    files = fx.run_files(spark, sf)
    return pr.backlog(files, fx.file_ledger(files), unit="rows")


@register("queue_pressure", f"""with {BACKLOG},
j as (select bl.topic, bl.count, cast(coalesce(limits.critical, 5000) as bigint) as limit_ from bl left join limits on bl.topic = limits.topic),
p as (select topic, count, limit_, cast(case when limit_ > 0 then least(100, floor(count / limit_ * 100)) else 0 end as int) as pressure_pct from j)
select topic, count, limit_ as "limit", pressure_pct,
  case when pressure_pct >= 90 then 'Critical' when pressure_pct >= 70 then 'Warning' else 'Normal' end as status
from p""")
def queue_pressure(spark, sf):
    return pr.queue_pressure(_backlog(spark, sf), fx.queue_limits(spark))


@register("threshold_action", f"""with {BACKLOG}
select bl.topic, bl.count,
  case when critical is not null and count >= critical then 'critical'
       when warning is not null and count >= warning then 'warning' else 'ok' end as level,
  case when (critical is not null and count >= critical) or (warning is not null and count >= warning) then action end as action
from bl left join limits on bl.topic = limits.topic""")
def threshold_action(spark, sf):
    return pr.threshold_action(_backlog(spark, sf), fx.queue_limits(spark))


@register("node_status", f"""with {INCREASE},
b as (select window_start,
  100 - sum(case when mode = 'idle' then increase end) * 1e6 / nullif(cast(sum(case when mode = 'idle' then covered_us end) as double), 0) * 100 as busy_pct,
  sum(case when mode = 'user' then increase end) * 1e6 / nullif(cast(sum(case when mode = 'user' then covered_us end) as double), 0) * 100 as user_pct,
  sum(case when mode = 'iowait' then increase end) * 1e6 / nullif(cast(sum(case when mode = 'iowait' then covered_us end) as double), 0) * 100 as iowait_pct
  from inc group by window_start)
select window_start, busy_pct,
  case when busy_pct < 90 then 'Healthy' else 'Stressed' end as node_status,
  case when user_pct > 80 then 'High Load' else 'Normal' end as gpu_status,
  case when iowait_pct > 50 then 'High' else 'Low' end as cpu_io_score,
  case when iowait_pct > 100 then 'High' else 'Low' end as gpu_io_score
from b""")
def node_status(spark, sf):
    """A25 over the daily CPU-busy figures (user % stands in for GPU utilisation, iowait % for volume MB/s)."""
    b = sm.cpu_busy(sm.counter_increase(fx.counter_samples(spark, sf), DAY, tie=["event_id"]))
    return b.select("window_start", "busy_pct", *pr.node_status(F.col("busy_pct"), F.col("user_pct"),
                                                                F.col("iowait_pct"), F.col("iowait_pct")))


@register("io_efficiency", """
with s as (select date_trunc('day', ts) as tick, sum(floor(value * 100)) / 86400.0 / 1048576 as mbps from events group by 1),
u as (select date_trunc('day', ts) as tick, count(distinct user_id) / 10.0 as cores, cast(count(distinct event_type) as bigint) as pods
      from events group by 1)
select s.tick, mbps, cores, pods,
  case when cores > 0 then mbps / cores else 0.0 end as mbps_per_core,
  case when pods > 0 then mbps / pods else 0.0 end as mbps_per_pod
from s join u on s.tick = u.tick""")
def io_efficiency(spark, sf):
    """Daily volume MB/s (bytes written per day) against cores and pods active that day."""
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn(
        "tick", F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 86400) * 86400))
    storage = ev.groupBy("tick").agg((F.sum(F.floor(F.col("value") * 100)) / 86400.0 / 1048576).alias("mbps"))
    usage = ev.groupBy("tick").agg((F.count_distinct("user_id") / 10.0).alias("cores"),
                                   F.count_distinct("event_type").cast("bigint").alias("pods"))
    return pr.io_efficiency(storage, usage, "tick")


@register("usage_totals", f"""with {USAGE}
select app, cast(sum(cpu_millicores) as bigint) as cpu_millicores, cast(sum(mem_mib) as bigint) as mem_mib,
  cast(count(*) as bigint) as pods, cast(sum(cpu_millicores) as bigint) / (41 * 1000.0) * 100 as cpu_pct
from usage group by app""")
def usage_totals(spark, sf):
    return pr.usage_totals(tx.parse_usage(fx.usage_lines(spark, sf)))
