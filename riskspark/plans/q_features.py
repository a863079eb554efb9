"""Feature queries (F1-F18, F25-F26) over the transaction stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..sources import fixtures as fx
from .catalog import register, with_tx

# ln/log1p/sqrt results are reported to 9 decimals: the two engines' log
# routines may differ in the last bit of a double.
R9 = 9


@register("features_time", with_tx("""
select trans_key, unix_time,
  cast(floor((unix_time % 86400) / 3600) as int) as hour_of_day,
  cast(floor(unix_time / 86400) % 7 as int) as day_of_week,
  cast((floor(unix_time / 86400) + 3) % 7 as int) as day_of_week_calendar,
  cast(floor(unix_time / 86400) % 7 >= 5 as int) as is_weekend,
  cast(floor((unix_time % 86400) / 3600) >= 22 or floor((unix_time % 86400) / 3600) <= 6 as int) as is_night
from tx"""))
def features_time(spark, sf):
    d = ft.day_of_week("unix_time")
    h = ft.hour_of_day("unix_time")
    return fx.tx(spark, sf).select(
        "trans_key", "unix_time", h.alias("hour_of_day"), d.alias("day_of_week"),
        ft.day_of_week("unix_time", "calendar").alias("day_of_week_calendar"),
        ft.is_weekend(d).alias("is_weekend"), ft.is_night(h).alias("is_night"))


@register("features_amount", with_tx(f"""
select trans_key, round(ln(1 + cast(amt as double)), {R9}) as amt_log,
       round(ln(1 + cast(city_pop as double)), {R9}) as city_pop_log
from tx"""))
def features_amount(spark, sf):
    return fx.tx(spark, sf).select(
        "trans_key", F.round(ft.amt_log("amt"), R9).alias("amt_log"),
        F.round(ft.city_pop_log(), R9).alias("city_pop_log"))


@register("features_geo", with_tx(f"""
select trans_key,
  round(sqrt(((merch_lat - lat) * 111.0) * ((merch_lat - lat) * 111.0)
           + ((merch_lon - lon) * 85.0) * ((merch_lon - lon) * 85.0)), {R9}) as distance_km,
  cast(floor(zip / 10000) as int) as zip_region
from tx"""))
def features_geo(spark, sf):
    return fx.tx(spark, sf).select(
        "trans_key", F.round(ft.distance_km("lat", "lon", "merch_lat", "merch_lon"), R9).alias("distance_km"),
        ft.zip_region().alias("zip_region"))


ENC = "cast(('0x' || substr(md5({c}), 1, 8))::bigint % {m} as int)"


@register("features_encoded", with_tx(f"""
select trans_key, {ENC.format(c='category', m=1000)} as category_encoded,
  {ENC.format(c='state', m=100)} as state_encoded,
  coalesce(cast(gender = 'M' as int), 0) as gender_encoded
from tx"""))
def features_encoded(spark, sf):
    return fx.tx(spark, sf).select(
        "trans_key", ft.category_encoded().alias("category_encoded"),
        ft.state_encoded().alias("state_encoded"), ft.gender_encoded().alias("gender_encoded"))


@register("features_all", with_tx(f"""
select trans_key, unix_time, cc_num, merchant, category, amt, first, last, state, zip, city_pop, lat, lon,
  merch_lat, merch_lon, merch_zipcode, is_fraud, fraud_score,
  round(ln(1 + cast(amt as double)), {R9}) as amt_log,
  cast(floor((unix_time % 86400) / 3600) as int) as hour_of_day,
  cast(floor(unix_time / 86400) % 7 as int) as day_of_week,
  cast(floor(unix_time / 86400) % 7 >= 5 as int) as is_weekend,
  cast(floor((unix_time % 86400) / 3600) >= 22 or floor((unix_time % 86400) / 3600) <= 6 as int) as is_night,
  round(sqrt(((merch_lat - lat) * 111.0) * ((merch_lat - lat) * 111.0)
           + ((merch_lon - lon) * 85.0) * ((merch_lon - lon) * 85.0)), {R9}) as distance_km,
  {ENC.format(c='category', m=1000)} as category_encoded,
  {ENC.format(c='state', m=100)} as state_encoded,
  coalesce(cast(gender = 'M' as int), 0) as gender_encoded,
  round(ln(1 + cast(city_pop as double)), {R9}) as city_pop_log,
  cast(floor(zip / 10000) as int) as zip_region
from tx"""))
def features_all(spark, sf):
    f = ft.build_features(fx.tx(spark, sf))
    return f.select(*[F.round(c, R9).alias(c) if c in ("amt_log", "distance_km", "city_pop_log") else F.col(c)
                      for c in f.columns])


@register("features_clean", with_tx("""
select trans_key, category, coalesce(case when trans_key % 10 != 0 then amt end, 0) as amt,
  coalesce(case when trans_key % 7 != 0 then lat end, 0) as lat, coalesce(case when trans_key % 3 != 0 then city_pop end, 0) as city_pop
from tx"""))
def features_clean(spark, sf):
    """text columns dropped, missing numbers 0."""
    t, k = fx.tx(spark, sf), F.col("trans_key")
    return ft.fill_zero(ft.drop_text_columns(t.select(
        "trans_key", "category", "gender", F.when(k % 10 != 0, F.col("amt")).alias("amt"), F.when(k % 7 != 0, F.col("lat")).alias("lat"),
        F.when(k % 3 != 0, F.col("city_pop")).alias("city_pop"), F.lit("x").alias("street"), F.lit("y").alias("job"))))


@register("card_velocity", with_tx("""
select trans_key, cc_num, unix_time,
  cast(count(*) over w as bigint) as txn_count_1h,
  cast(sum(cast(amt as decimal(18,2))) over w as double) as amount_1h
from tx
window w as (partition by cc_num order by unix_time range between 3600 preceding and current row)"""))
def card_velocity(spark, sf):
    """Transactions and amount per card over the trailing hour."""
    tx = fx.tx(spark, sf).select("trans_key", "cc_num", "unix_time", "amt")
    return ft.velocity(tx, seconds=3600).drop("amt").withColumnsRenamed({"txn_count_3600s": "txn_count_1h", "amount_3600s": "amount_1h"})


@register("time_bins", with_tx("""
select cast(floor((unix_time % 86400) / 3600) as int) as hour_of_day,
  cast(floor((unix_time % 86400) / 3600) >= 22 or floor((unix_time % 86400) / 3600) <= 6 as int) as is_night,
  cast(count(*) as bigint) as n, cast(sum(is_fraud) as bigint) as n_fraud
from tx group by 1, 2"""))
def time_bins(spark, sf):
    """time-of-day bins (hour and night flag) with counts."""
    h = ft.hour_of_day("unix_time")
    return (fx.tx(spark, sf).groupBy(h.alias("hour_of_day"), ft.is_night(h).alias("is_night"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.sum("is_fraud").cast("bigint").alias("n_fraud")))


@register("elapsed_label", """
select event_id, value,
  printf('%02d:%02d.%d', cast(floor(t / 600) as bigint), cast(floor((t - floor(t / 600) * 600) / 10) as bigint),
         cast((t - floor(t / 600) * 600) % 10 as bigint)) as elapsed
from (select event_id, value, cast(round(cast(value as decimal(20,3)) * 10, 0) as bigint) as t from events)""")
def elapsed_label(spark, sf):
    """seconds (here: event values) as MM:SS.S."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return ev.select("event_id", "value", ft.elapsed_label("value").alias("elapsed"))


@register("clamp_pct", """
select event_id, value, case when m > 0 then least(100.0, round(value * 100 / m, 2)) else 0.0 end as pct
from (select event_id, value, max(value) over (partition by event_type) / 2 as m from events)""")
def clamp_pct(spark, sf):
    """value as percent of half the per-type maximum, capped at 100."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    m = ev.groupBy("event_type").agg((F.max("value") / 2).alias("m"))
    j = ev.join(m, "event_type")  # AQE broadcasts the measured aggregate
    return j.select("event_id", "value", ft.clamp_pct(F.col("value"), F.col("m")).alias("pct"))


@register("model_input", with_tx(f"""
select trans_key, cast(amt as double) as amt, lat, lon as long, cast(city_pop as double) as city_pop,
  cast(unix_time as double) as unix_time, merch_lat, merch_lon as merch_long, cast(merch_zipcode as double) as merch_zipcode,
  cast(zip as double) as zip, round(ln(1 + cast(amt as double)), {R9}) as amt_log,
  cast(floor((unix_time % 86400) / 3600) as double) as hour_of_day,
  cast(floor(unix_time / 86400) % 7 as double) as day_of_week,
  cast(floor(unix_time / 86400) % 7 >= 5 as double) as is_weekend,
  cast(floor((unix_time % 86400) / 3600) >= 22 or floor((unix_time % 86400) / 3600) <= 6 as double) as is_night,
  round(sqrt(((merch_lat - lat) * 111.0) * ((merch_lat - lat) * 111.0)
           + ((merch_lon - lon) * 85.0) * ((merch_lon - lon) * 85.0)), {R9}) as distance_km,
  cast({ENC.format(c='category', m=1000)} as double) as category_encoded,
  cast({ENC.format(c='state', m=100)} as double) as state_encoded,
  cast(coalesce(cast(gender = 'M' as int), 0) as double) as gender_encoded,
  round(ln(1 + cast(city_pop as double)), {R9}) as city_pop_log,
  cast(floor(zip / 10000) as double) as zip_region
from tx"""))
def model_input(spark, sf):
    """F16 (+F13): the 20 ordered model inputs as doubles, missing columns as 0."""
    f = ft.build_features(fx.tx(spark, sf))
    cols = ft.model_columns(f)
    return f.select("trans_key", *[F.round(c, R9).alias(n) if n in ("amt_log", "distance_km", "city_pop_log") else c
                                   for c, n in zip(cols, ft.MODEL_FEATURES)])
