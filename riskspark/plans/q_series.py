"""Series queries (W1-W8, X7 in batch) over poll ticks and metric samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as sr
from ..operators import smoothing
from ..operators.samples import label
from ..sources import fixtures as fx
from .catalog import register

TICKS = f"ticks as ({fx.poll_ticks_sql()})"
GAUGE = f"g as ({fx.gauge_samples_sql()})"
COUNTER = f"c as ({fx.counter_samples_sql()})"
DT = "(epoch_us(tick) - epoch_us(lag(tick) over w)) / 1e6"


@register("rate_delta", f"""
with {TICKS}
select series, tick, value, lag(value) over w as prev_value, {DT} as dt,
  case when {DT} > 0.1 then (value - lag(value) over w) / ({DT}) end as rate
from ticks window w as (partition by series order by tick)""")
def rate_delta(spark, sf):
    r = sr.rate_delta(fx.poll_ticks(spark, sf), ["series"], "tick", "value")
    return r.select("series", "tick", "value", "prev_value", "dt", "rate")


@register("velocity_per_min", f"""
with {TICKS}
select series, tick, value,
  case when {DT} > 0.1 then greatest(0.0, value - lag(value) over w) / ({DT}) * 60 end as per_min
from ticks window w as (partition by series order by tick)""")
def velocity_per_min(spark, sf):
    r = sr.velocity_per_min(fx.poll_ticks(spark, sf), ["series"], "tick", "value")
    return r.select("series", "tick", "value", "per_min")


@register("byte_growth", f"""
with {TICKS}, b as (select series as volume, tick, cast(value * 3 * 1048576 as bigint) as bytes from ticks)
select volume, tick, bytes,
  case when (epoch_us(tick) - epoch_us(lag(tick) over w)) / 1e6 > 0
       then greatest(0.0, cast(bytes - lag(bytes) over w as double)) / 1048576 / ((epoch_us(tick) - epoch_us(lag(tick) over w)) / 1e6)
       else 0.0 end as mib_per_s
from b window w as (partition by volume order by tick)""")
def byte_growth(spark, sf):
    t = fx.poll_ticks(spark, sf)
    b = t.select(F.col("series").alias("volume"), "tick", (F.col("value") * 3 * 1048576).cast("bigint").alias("bytes"))
    return sr.byte_growth(b, ["volume"], "tick", "bytes").select("volume", "tick", "bytes", "mib_per_s")


@register("ema", f"""
with recursive {GAUGE},
s as (select metric, ts, event_id, value * 20 as x,
             row_number() over (partition by metric order by ts, event_id) as rn from g),
e(metric, rn, ts, event_id, x, ema) as (
  select metric, rn, ts, event_id, x,
         case when abs(x - 0.0) > 50000.0 then x else 0.0 * (1.0::double - 0.3::double) + x * 0.3::double end
  from s where rn = 1
  union all
  select s.metric, s.rn, s.ts, s.event_id, s.x,
         case when abs(s.x - e.ema) > 50000.0 then s.x else e.ema * (1.0::double - 0.3::double) + s.x * 0.3::double end
  from e join s on s.metric = e.metric and s.rn = e.rn + 1)
select metric, ts, event_id, x, ema from e""")
def ema(spark, sf):
    g = fx.gauge_samples(spark, sf).select("metric", "ts", "event_id", (F.col("value") * 20).alias("x"))
    return smoothing.ema(g, ["metric"], ["ts", "event_id"], "x", alpha=0.3, reset=50_000.0)


@register("last_n_points", f"""
with {GAUGE}
select * from (
  select metric, instance, ts, event_id, value,
         cast(row_number() over (partition by metric, instance order by ts desc, event_id desc) as int) as pos
  from g) where pos <= 60""")
def last_n_points(spark, sf):
    g = fx.gauge_samples(spark, sf).select("metric", label("instance").alias("instance"), "ts", "event_id", "value")
    return sr.last_n_points(g, ["metric", "instance"], ["ts", "event_id"], 60).withColumn("pos", F.col("pos").cast("int"))


@register("monotone_max", f"""
with {COUNTER}
select metric, instance, ts, event_id, value,
  max(value) over (partition by metric, instance order by ts, event_id rows between unbounded preceding and current row) as monotone
from c""")
def monotone_max(spark, sf):
    c = fx.counter_samples(spark, sf).select("metric", label("instance").alias("instance"), "ts", "event_id", "value")
    return sr.monotone_max(c, ["metric", "instance"], ["ts", "event_id"], "value")


@register("running_total", f"""
with {GAUGE}
select metric, instance, ts, event_id, value,
  sum(value) over (partition by metric, instance order by ts, event_id rows between unbounded preceding and current row) as running_sum
from g""")
def running_total(spark, sf):
    """Running sum per series (the cumulative counter a store keeps)."""
    g = fx.gauge_samples(spark, sf).select("metric", label("instance").alias("instance"), "ts", "event_id", "value")
    return sr.cumulative(g, ["metric", "instance"], ["ts", "event_id"], "value", "sum", name="running_sum")


@register("combine_sources", f"""
with {TICKS},
a as (select tick, value as a_value from ticks where series = 'view'),
b as (select tick, value as b_value from ticks where series = 'click')
select coalesce(a.tick, b.tick) as tick, a_value, b_value, greatest(a_value, b_value) as combined,
  coalesce(a_value, b_value) as first_non_null
from a full outer join b on a.tick = b.tick""")
def combine_sources(spark, sf):
    t = fx.poll_ticks(spark, sf)
    return sr.combine_sources(t.where(F.col("series") == "view"), t.where(F.col("series") == "click"), ["tick"])


@register("tumbling_counts", """
select time_bucket(interval 1 minute, ts) as window_start, time_bucket(interval 1 minute, ts) + interval 1 minute as window_end,
  event_type, cast(count(*) as bigint) as n, cast(sum(cast(value as decimal(18,2))) as double) as total_value
from events group by 1, 2, 3""")
def tumbling_counts(spark, sf):
    """X7 (batch form): events per type and one-minute event-time window."""
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", fx.ntz_as_utc("ts"))
    w = ev.groupBy(F.window("ts", "1 minute"), "event_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_value"))
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "event_type", "n", "total_value")
