"""Risk and business queries over the scored transaction stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counters as ct
from ..operators import risk
from ..operators.sketch import GAMMA, sketch_rows
from ..sources import fixtures as fx
from .catalog import register, with_tx

FLAG = "fraud_score >= 0.52"
MONEY = "cast(coalesce(sum(cast(amt as decimal(18,2))), 0) as double)"
HR = f"(select * replace (coalesce(category, 'unknown') as category, coalesce(state, 'unknown') as state) from tx where {FLAG})"


@register("category_risk", with_tx(f"""
select category, cast(count(*) as bigint) as flagged_count, {MONEY} as flagged_amount,
       cast(sum(cast(fraud_score as decimal(12,4))) as double) / cast(count(*) as double) as avg_score
from {HR} h group by category"""))
def category_risk(spark, sf):
    return risk.category_risk(fx.tx(spark, sf))


@register("state_risk", with_tx(f"""
select state, cast(count(*) as bigint) as flagged_count, {MONEY} as flagged_amount
from {HR} h group by state"""))
def state_risk(spark, sf):
    return risk.state_risk(fx.tx(spark, sf))


@register("risk_rollup", with_tx(f"""
select category, state, cast(grouping(category, state) as int) as gid,
       cast(count(*) as bigint) as flagged_count, {MONEY} as flagged_amount
from {HR} h group by rollup(category, state)"""))
def risk_rollup(spark, sf):
    return risk.risk_rollup(fx.tx(spark, sf))


@register("risk_cube", with_tx(f"""
select category, state, cast(grouping(category, state) as int) as gid,
       cast(count(*) as bigint) as flagged_count, {MONEY} as flagged_amount
from {HR} h group by cube(category, state)"""))
def risk_cube(spark, sf):
    return risk.risk_rollup(fx.tx(spark, sf), cube=True)


@register("risk_distribution", with_tx("""
select b.band, cast(count(t.band) as bigint) as n
from (values ('low'), ('medium'), ('high')) b(band)
left join (select case when fraud_score < 0.6 then 'low' when fraud_score < 0.9 then 'medium' else 'high' end as band from tx) t
  on t.band = b.band
group by b.band"""))
def risk_distribution(spark, sf):
    return risk.risk_distribution(fx.tx(spark, sf))


HIST_SQL = """, c as (select cast(least(floor(fraud_score * 20), 19) as int) as bin, count(*) as n from tx group by 1),
     h as (select cast(b.i as int) as bin, printf('%.2f-%.2f', b.i * (1.0 / 20), (b.i + 1) * (1.0 / 20)) as bin_label,
                  cast(coalesce(c.n, 0) as bigint) as n
           from range(20) b(i) left join c on c.bin = b.i)
"""


@register("score_histogram", with_tx(HIST_SQL + "select bin, bin_label, n from h"))
def score_histogram(spark, sf):
    return risk.score_histogram(fx.tx(spark, sf))


@register("score_histogram_height", with_tx(HIST_SQL + """
select bin, bin_label, n,
       cast(least(100, floor(n / greatest(1.0, cast(sum(n) over () as double) / 20) * 100)) as int) as height
from h"""))
def score_histogram_height(spark, sf):
    return risk.score_histogram(fx.tx(spark, sf), with_height=True)


ALERT_COLS = """cast(round(cast(fraud_score as decimal(12,4)), 3) as double) as risk_score,
  coalesce(merchant, 'Unknown') as merchant, category,
  cast(round(cast(amt as decimal(18,2)), 2) as double) as amount, cc_num,
  '**** **** **** ' || right(cast(cc_num as varchar), 4) as cc_num_masked, state,
  coalesce(first, 'Unknown') as first, coalesce(last, 'Unknown') as last,
  strftime(make_timestamp(unix_time * 1000000), '%Y-%m-%dT%H:%M:%SZ') as timestamp"""


@register("recent_alerts", with_tx(f"""
select {ALERT_COLS} from {HR} h
order by unix_time desc, trans_key desc, cc_num desc, amt desc, fraud_score desc, merchant desc
limit 100"""))
def recent_alerts(spark, sf):
    return risk.recent_alerts(fx.tx(spark, sf), 100)


@register("alert_projection", with_tx(f"""
select {ALERT_COLS}, cast((select max(unix_time) from tx) - unix_time as bigint) as seconds_ago from {HR} h"""))
def alert_projection(spark, sf):
    return risk.alerts_with_age(fx.tx(spark, sf))


@register("alert_volume_by_category", with_tx(f"""
select category, {MONEY} as amount from {HR} h group by category"""))
def alert_volume_by_category(spark, sf):
    return risk.alert_volume_by_category(fx.tx(spark, sf))


@register("top_category", with_tx(f"""
select category as top_category, {MONEY} as top_category_amount from {HR} h
group by category order by top_category_amount desc, category limit 1"""))
def top_category(spark, sf):
    return risk.top_category(fx.tx(spark, sf))


@register("state_rank", with_tx(f"""
select * from (
  select cast(rank() over (order by {MONEY} desc) as int) as rank, state,
         {MONEY} as fraud_amount, cast(count(*) as bigint) as count
  from {HR} h group by state) where rank <= 8"""))
def state_rank(spark, sf):
    return risk.state_rank(fx.tx(spark, sf), 8)


CONC_SQL = f"""
k as (select cast(greatest(1, floor(count(*) * 0.01)) as bigint) as k from tx),
r as (select amt, fraud_score,
             row_number() over (order by fraud_score desc, unix_time desc, trans_key desc, amt desc) as rn from tx),
c as (select (select k from k) as top_count,
             cast(coalesce(sum(case when {FLAG} and rn <= (select k from k) then cast(amt as decimal(18,2)) end), 0) as double) as top_fraud_amount,
             cast(coalesce(sum(case when {FLAG} then cast(amt as decimal(18,2)) end), 0) as double) as fraud_amount
      from r)"""


@register("risk_concentration", with_tx(", " + CONC_SQL.strip() + """
select top_count, top_fraud_amount, fraud_amount,
       case when fraud_amount > 0 then top_fraud_amount / greatest(1.0, fraud_amount) * 100 else 0.0 end as concentration_pct
from c"""))
def risk_concentration(spark, sf):
    return risk.risk_concentration(fx.tx(spark, sf))


@register("business_summary", with_tx(f""", {CONC_SQL.strip()},
b as (select cast(count(*) as bigint) as transactions_analyzed, {MONEY} as total_amount,
             cast(count(case when {FLAG} then 1 end) as bigint) as high_risk_count,
             cast(coalesce(sum(case when {FLAG} then cast(amt as decimal(18,2)) end), 0) as double) as fraud_exposure_identified,
             (max(unix_time) - min(unix_time)) / 3600.0 as elapsed_hours from tx),
t as (select category as top_category, {MONEY} as top_category_amount from {HR} h
      group by category order by top_category_amount desc, category limit 1)
select transactions_analyzed, total_amount, high_risk_count, fraud_exposure_identified,
       fraud_exposure_identified / greatest(1.0, total_amount) as fraud_rate,
       fraud_exposure_identified / greatest(1.0, total_amount) * 100 as fraud_rate_pct,
       cast(floor(high_risk_count / cast(greatest(1, transactions_analyzed) as double) * 1e6) as bigint) as alerts_per_million,
       high_risk_count / cast(greatest(1, transactions_analyzed) as double) as high_risk_txn_rate,
       case when coalesce(elapsed_hours, 0) != 0 then fraud_exposure_identified / greatest(0.001, elapsed_hours) * 8760 else 0.0 end
         as projected_annual_savings,
       top_category, top_category_amount,
       (select case when fraud_amount > 0 then top_fraud_amount / greatest(1.0, fraud_amount) * 100 else 0.0 end from c)
         as concentration_pct
from b left join t on true"""))
def business_summary(spark, sf):
    return risk.business_summary(fx.tx(spark, sf))


@register("fraud_split", with_tx(f"""
select cast(count(case when {FLAG} then 1 end) as bigint) as fraud,
       cast(greatest(0, count(*) - count(case when {FLAG} then 1 end)) as bigint) as legit from tx"""))
def fraud_split(spark, sf):
    return risk.fraud_split(fx.tx(spark, sf))


@register("mask_card", with_tx("""
select trans_key, cc_num, '**** **** **** ' || right(cast(cc_num as varchar), 4) as cc_num_masked from tx"""))
def mask_card(spark, sf):
    from ..functions.features import mask_card as mc
    return fx.tx(spark, sf).select("trans_key", "cc_num", mc("cc_num").alias("cc_num_masked"))


@register("totals", with_tx(f"""
select cast(count(*) as bigint) as total_txns_scored, {MONEY} as total_amount_processed,
  cast(count(case when {FLAG} then 1 end) as bigint) as fraud_blocked_count,
  cast(coalesce(sum(case when {FLAG} then cast(amt as decimal(18,2)) end), 0) as double) as total_fraud_amount_identified
from tx"""))
def totals(spark, sf):
    return risk.totals(fx.tx(spark, sf))


@register("business_kpis", with_tx(f""", {CONC_SQL.strip()},
b as (select cast(count(*) as bigint) as n, {MONEY} as total_amount,
             cast(count(case when {FLAG} then 1 end) as bigint) as flagged_n,
             cast(coalesce(sum(case when {FLAG} then cast(amt as decimal(18,2)) end), 0) as double) as fraud_amt,
             (max(unix_time) - min(unix_time)) / 3600.0 as hours,
             count(case when fraud_score > 0.5 and is_fraud = 1 then 1 end) as tp,
             count(case when fraud_score > 0.5 and is_fraud != 1 then 1 end) as fp,
             count(case when not (fraud_score > 0.5) and is_fraud = 1 then 1 end) as fn,
             count(case when not (fraud_score > 0.5) and is_fraud != 1 then 1 end) as tn,
             cast(count(case when fraud_score < 0.6 then 1 end) as bigint) as risk_low,
             cast(count(case when fraud_score >= 0.6 and fraud_score < 0.9 then 1 end) as bigint) as risk_medium,
             cast(count(case when fraud_score >= 0.9 then 1 end) as bigint) as risk_high,
             count(case when {FLAG} and unix_time >= (select (max(unix_time) // 86400) * 86400 from tx) then 1 end) as last_flagged
      from tx),
lat as (select case when value <= 0 then null else cast(ceil(ln(value) / ln({GAMMA!r})) as int) end as i, count(*) as n from events
        where value is not null and isfinite(value) group by 1),
run as (select i, sum(n) over (order by i nulls first) as upto, sum(n) over () as total from lat),
mid as (select case when i is null then 0.0 else 2 * pow({GAMMA!r}, i) / ({GAMMA!r} + 1) end as v from run
        where upto >= greatest(1, ceil(total * 0.5)) order by upto limit 1)
select fraud_amt as fraud_exposure_identified_usd, n as transactions_analyzed, flagged_n as high_risk_flagged,
  fraud_amt / greatest(1.0, total_amount) * 100 as fraud_rate_pct,
  cast(floor(flagged_n / cast(greatest(1, n) as double) * 1e6) as bigint) as alerts_per_1m,
  flagged_n / cast(greatest(1, n) as double) as high_risk_txn_rate,
  case when coalesce(hours, 0) != 0 then fraud_amt / greatest(0.001, hours) * 8760 else 0.0 end as annual_savings_usd,
  (select case when fraud_amount > 0 then top_fraud_amount / greatest(1.0, fraud_amount) * 100 else 0.0 end from c)
    as risk_concentration_pct,
  case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0.0 end as precision_at_threshold,
  case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0.0 end as recall,
  case when fp + tn > 0 then cast(fp as double) / (fp + tn) else 0.0 end as false_positive_rate,
  risk_low, risk_medium, risk_high, 
  last_flagged / greatest(1.0, (select max(unix_time) % 86400 from tx) / 60.0) as fraud_velocity_per_min,
  (select string_agg(k || '=' || n, ',' order by k) from (select coalesce(category, 'unknown') as k, count(*) as n from tx where {FLAG} group by 1)) as category_risk,
  (select string_agg(k || '=' || n, ',' order by k) from (select coalesce(state, 'unknown') as k, count(*) as n from tx where {FLAG} group by 1)) as state_risk,
  round((select v from mid), 9) as decision_latency_ms, (select count(*) > 0 from mid) as decision_latency_known,
  cast(null as double) as storage_util_pct, false as storage_util_known
from b"""))
def business_kpis(spark, sf):
    """The 17 KPIs; event values stand for latencies, the store has no storage utilisation.  Maps as text."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("value", fx.ntz_as_utc("ts").alias("ts"))
    day = F.floor(F.unix_seconds("ts") / 86400)
    folded = ct.metric_fold(sketch_rows(ev.withColumn("batch_id", day), "value", "decision_latency_ms", ts="ts"))
    k = risk.business_kpis(fx.tx(spark, sf), folded=folded)
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return k.withColumns({"category_risk": text("category_risk"), "state_risk": text("state_risk"),
                          "decision_latency_ms": F.round("decision_latency_ms", 9)})
