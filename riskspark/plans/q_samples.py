"""Metric-sample queries (Q1m-Q9m) over the gauge and counter stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import samples as sm
from ..operators.samples import label
from ..sources import fixtures as fx
from .catalog import register

GAUGE = f"g as ({fx.gauge_samples_sql()})"
COUNTER = f"c as ({fx.counter_samples_sql()})"
DAY = 86400
INSTANT = f"""{GAUGE},
atv as (select max(ts) as at_ts from g),
inst as (select * from (
  select metric, instance, cpu, mode, dimension, ts, value,
         row_number() over (partition by metric, instance, cpu, mode, dimension order by ts desc, event_id desc) as rn
  from g, atv where ts > atv.at_ts - interval {DAY} second and ts <= atv.at_ts) where rn = 1)"""


def _gauge_instant(spark, sf):
    return sm.instant(fx.gauge_samples(spark, sf), lookback_seconds=DAY, tie=["event_id"])


def _flat(df):
    return df.select("metric", *[label(n).alias(n) for n in ("instance", "cpu", "mode", "dimension")],
                     *[c for c in df.columns if c not in ("metric", "labels")])


@register("sample_instant", f"""with {INSTANT}
select metric, instance, cpu, mode, dimension, ts, value from inst""")
def sample_instant(spark, sf):
    return _flat(_gauge_instant(spark, sf))


@register("sample_sum_by_label", f"""with {INSTANT}
select metric, sum(value) / 1024 / 1024 as sum_value, avg(value) as avg_value, cast(count(*) as bigint) as n_series
from inst where dimension = 'read_bytes_per_sec' group by metric""")
def sample_sum_by_label(spark, sf):
    return sm.sum_by_label(_gauge_instant(spark, sf), {"dimension": "read_bytes_per_sec"}, scale=1024 * 1024)


@register("sample_avg_by_instance", f"""with {INSTANT}
select metric, instance, sum(value) as sum_value, avg(value) as avg_value, cast(count(*) as bigint) as n_series
from inst group by metric, instance""")
def sample_avg_by_instance(spark, sf):
    """Q3m: sum/avg across series of an instant vector, by one label."""
    return sm.sum_by_label(_gauge_instant(spark, sf), by=["instance"])


INCREASE = f"""{COUNTER},
p as (select metric, instance, cpu, mode, ts, value,
             floor(epoch(ts) / {DAY}) as w,
             lag(value) over (partition by metric, instance, cpu, mode order by ts, event_id) as prev,
             epoch_us(ts) - lag(epoch_us(ts)) over (partition by metric, instance, cpu, mode order by ts, event_id) as step
      from c),
inc as (select metric, instance, cpu, mode, make_timestamp(cast(w * {DAY} as bigint) * 1000000) as window_start,
               sum(case when prev is null then 0.0 when value >= prev then value - prev else value end) as increase,
               cast(count(*) as bigint) as n_samples, cast(coalesce(sum(step), 0) as bigint) as covered_us
        from p group by metric, instance, cpu, mode, w)"""


def _increase(spark, sf):
    return sm.counter_increase(fx.counter_samples(spark, sf), DAY, tie=["event_id"])


def _flat3(df):
    return df.select("metric", *[label(n).alias(n) for n in ("instance", "cpu", "mode")],
                     *[c for c in df.columns if c not in ("metric", "labels")])


@register("counter_rate", f"""with {INCREASE}
select metric, instance, cpu, mode, window_start, increase, n_samples, covered_us,
  case when covered_us > 0 then increase * 1e6 / cast(covered_us as double) end as rate from inc""")
def counter_rate(spark, sf):
    return _flat3(sm.counter_rate(fx.counter_samples(spark, sf), DAY, tie=["event_id"]))


@register("cpu_busy", f"""with {INCREASE}
select window_start,
  100 - sum(case when mode = 'idle' then increase end) * 1e6 / nullif(cast(sum(case when mode = 'idle' then covered_us end) as double), 0) * 100 as busy_pct,
  sum(case when mode = 'user' then increase end) * 1e6 / nullif(cast(sum(case when mode = 'user' then covered_us end) as double), 0) * 100 as user_pct,
  sum(case when mode = 'iowait' then increase end) * 1e6 / nullif(cast(sum(case when mode = 'iowait' then covered_us end) as double), 0) * 100 as iowait_pct
from inc group by window_start""")
def cpu_busy(spark, sf):
    return sm.cpu_busy(_increase(spark, sf))


# the namespace of the stand-in samples is their mode label
POD_CPU = """
select metric, window_start, round(sum(case when covered_us > 0 then increase * 1e6 / cast(covered_us as double) end) * 1000, 6) as cpu_millicores
from inc {where} group by metric, window_start"""


def _millicores(df):
    return df.withColumn("cpu_millicores", F.round("cpu_millicores", 6))


@register("pod_cpu_millicores", f"with {INCREASE}" + POD_CPU.format(where=""))
def pod_cpu_millicores(spark, sf):
    """Q8m: sum(rate(cpu seconds)) * 1000 per metric and window."""
    return _millicores(sm.pod_cpu_millicores(fx.counter_samples(spark, sf), DAY, tie=["event_id"]))


@register("pod_cpu_namespace", f"with {INCREASE}" + POD_CPU.format(where="where mode = 'user'"))
def pod_cpu_namespace(spark, sf):
    """Q8m with its namespace filter."""
    return _millicores(sm.pod_cpu_millicores(fx.counter_samples(spark, sf), DAY, tie=["event_id"], match={"mode": "user"}))


@register("sample_range", f"""with {GAUGE},
edge as (select cast(floor(epoch(min(ts)) / 3600) * 3600 as bigint) as t0, cast(floor(epoch(max(ts)) / 3600) * 3600 + 3600 as bigint) as t1 from g),
grid as (select unnest(range(t0, t1 + 1, 3600)) as t from edge),
series as (select distinct metric, instance, cpu, mode, dimension from g),
cells as (select series.*, t from series, grid),
found as (select c.metric, c.instance, c.cpu, c.mode, c.dimension, c.t, arg_max(g.value, (g.ts, g.event_id)) as value
  from cells c join g on g.metric = c.metric and g.instance = c.instance and g.cpu = c.cpu and g.mode = c.mode and g.dimension = c.dimension
    and g.ts > make_timestamp((c.t - 7200) * 1000000) and g.ts <= make_timestamp(c.t * 1000000) group by all)
select metric, c.t as at_second, cast(count(*) as bigint) as n_series, cast(count(f.value) as bigint) as n_filled,
  round(sum(coalesce(f.value, 0)), 6) as total from cells c left join found f using (metric, instance, cpu, mode, dimension, t)
group by metric, c.t""")
def sample_range(spark, sf):
    """Q1m over a grid of hours with a lookback of two: per metric and instant the series, those with a value, and
    the sum with gaps as 0."""
    g = fx.gauge_samples(spark, sf)
    edge = g.agg(F.floor(F.unix_seconds(F.min("ts")) / 3600).alias("a"), F.floor(F.unix_seconds(F.max("ts")) / 3600).alias("b")).first()
    if edge["a"] is None:
        return spark.createDataFrame([], "metric string, at_second bigint, n_series bigint, n_filled bigint, total double")
    r = sm.instant_range(g, edge["a"] * 3600, edge["b"] * 3600 + 3600, 3600, lookback_seconds=7200, missing=None, tie=["event_id"])
    return r.groupBy("metric", F.unix_seconds("at").alias("at_second")).agg(
        F.count(F.lit(1)).alias("n_series"), F.count("value").alias("n_filled"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 6).alias("total"))


@register("distinct_cpus", f"""with {GAUGE}
select metric, cast(count(distinct cpu) as bigint) as n_cpu from g group by metric""")
def distinct_cpus(spark, sf):
    return sm.distinct_label_values(fx.gauge_samples(spark, sf), "cpu")


@register("mem_used_pct", f"""with {INSTANT},
t as (select instance, sum(value) as total from inst where metric = 'view' group by instance),
a as (select instance, sum(value) as avail from inst where metric = 'click' group by instance)
select t.instance, total, avail, case when total != 0 then (total - avail) / total * 100 end as used_pct
from t join a on t.instance = a.instance""")
def mem_used_pct(spark, sf):
    return sm.ratio_used_pct(_gauge_instant(spark, sf), "view", "click", ["instance"])


@register("pct_of_max", f"""with {INSTANT},
m as (select metric, max(value) as mx from inst group by metric)
select inst.metric, instance, cpu, mode, dimension, ts, value,
  case when mx > 0 then least(100.0, round(value * 100 / mx, 2)) else 0.0 end as pct_of_max
from inst join m on inst.metric = m.metric""")
def pct_of_max(spark, sf):
    return _flat(sm.pct_of_max(_gauge_instant(spark, sf), "value", by=["metric"]))


@register("pod_mem_mib", f"""with {INSTANT}
select metric, sum(value) / 1048576 as mem_mib, cast(count(*) as bigint) as n_series from inst group by metric""")
def pod_mem_mib(spark, sf):
    """Q8m: ``sum(working set bytes) / 1048576`` over the instant vector, per metric."""
    return sm.pod_mem_mib(_gauge_instant(spark, sf))
