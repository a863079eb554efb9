"""Source, sink-side and metric-store queries (S3-S7, S12-S22, X3 in batch)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import counters as ct
from ..operators.pressure import backlog
from ..sources import fixtures as fx
from ..session import checkpoint_path
from ..sources import readers as rd
from .catalog import REGISTRY, register, with_tx
from . import q_risk  # noqa: F401  (its SQL checks the snapshot)

FILES = f"files as ({fx.run_files_sql()})"


@register("latest_run", f"with {FILES}\nselect * from files where run = (select max(run) from files)")
def latest_run(spark, sf):
    return rd.latest_run(fx.run_files(spark, sf))


@register("exclude_processed", f"""with {FILES}, ledger as ({fx.RUN_LEDGER_SQL})
select * from files f where not exists (select 1 from ledger l where l.run = f.run)""")
def exclude_processed(spark, sf):
    files = fx.run_files(spark, sf)
    return rd.exclude_processed(files, fx.run_ledger(files), "run")


@register("recent_files", f"""with {FILES},
t as (select * from files order by mtime desc, file desc, run desc limit 100),
c as (select *, sum(rows) over (order by mtime desc, file desc, run desc rows between unbounded preceding and current row) as cum_rows from t)
select * from c where cum_rows - rows < 20000""")
def recent_files(spark, sf):
    return rd.recent_files(fx.run_files(spark, sf), n=100, min_rows=20_000).withColumn("cum_rows", F.col("cum_rows").cast("bigint"))


@register("rows_in_run", f"with {FILES}\nselect run, cast(sum(rows) as bigint) as rows from files group by run")
def rows_in_run(spark, sf):
    return rd.rows_in_run(fx.run_files(spark, sf), "run", rows="rows")


@register("backlog", f"""with {FILES}, ledger as ({fx.FILE_LEDGER_SQL})
select topic, cast(sum(rows) as bigint) as count from files f
where not exists (select 1 from ledger l where l.file = f.file and l.run = f.run) group by topic""")
def backlog_rows(spark, sf):
    files = fx.run_files(spark, sf)
    return backlog(files, fx.file_ledger(files), unit="rows")


@register("dedupe_batches", with_tx(f", r as ({fx.TX_REPLAYED_SQL})\nselect distinct * from r"))
def dedupe_batches(spark, sf):
    return rd.dedupe_batches(fx.tx_replayed(spark, sf))


TX_TEXT_SCHEMA = T.StructType([
    T.StructField("trans_key", T.LongType()), T.StructField("unix_time", T.LongType()),
    T.StructField("cc_num", T.LongType()), T.StructField("category", T.StringType()),
    T.StructField("amt", T.DecimalType(18, 2)), T.StructField("state", T.StringType()),
])
CONFORM_SQL = f""", t as ({fx.tx_text_sql()}),
c as (select try_cast(trans_key as bigint) as trans_key, try_cast(unix_time as bigint) as unix_time,
             try_cast(cc_num as bigint) as cc_num, category, try_cast(amt as decimal(18,2)) as amt, state,
             (amt is not null and try_cast(amt as decimal(18,2)) is null) as amt_bad, t.amt as amt_text,
             t.trans_key as trans_key_text, t.unix_time as unix_time_text, t.cc_num as cc_num_text
      from t)"""


@register("conform", with_tx(CONFORM_SQL + """
select trans_key, unix_time, cc_num, category, amt, state, cast(case when amt_bad then 1 else 0 end as int) as n_errors from c"""))
def conform(spark, sf):
    c = rd.conform(fx.tx_text(spark, sf), TX_TEXT_SCHEMA)
    return c.withColumn("n_errors", F.size("_cast_errors").cast("int")).drop("_cast_errors")


@register("quarantine_good", with_tx(CONFORM_SQL + """
select trans_key, unix_time, cc_num, category, amt, state from c where not amt_bad and category is not null"""))
def quarantine_good(spark, sf):
    good, _ = rd.quarantine(fx.tx_text(spark, sf), TX_TEXT_SCHEMA, required=["category"])
    return good


@register("quarantine_bad", with_tx(CONFORM_SQL + """
select trans_key_text as trans_key, unix_time_text as unix_time, cc_num_text as cc_num, category, amt_text as amt, state,
  array_to_string(list_filter([case when amt_bad then 'cast:amt' end,
                               case when category is null then 'missing:category' end], lambda x: x is not null), ';') as reason
from c where amt_bad or category is null"""))
def quarantine_bad(spark, sf):
    _, bad = rd.quarantine(fx.tx_text(spark, sf), TX_TEXT_SCHEMA, required=["category"])
    return bad


@register("retention", with_tx("""
select trans_key, unix_time, amt from tx where unix_time >= (select max(unix_time) from tx) - 30 * 24 * 3600"""))
def retention(spark, sf):
    return rd.retention(fx.tx(spark, sf).select("trans_key", "unix_time", "amt"), hours=30 * 24)


@register("sample_limit", with_tx("""
select unix_time, trans_key, cc_num, amt, fraud_score, merchant from tx
order by unix_time, trans_key, cc_num, amt, fraud_score, merchant limit 500000"""))
def sample_limit(spark, sf):
    keys = ["unix_time", "trans_key", "cc_num", "amt", "fraud_score", "merchant"]
    return rd.sample_limit(fx.tx(spark, sf).select(*keys), 500_000, keys)


@register("union_batches", with_tx("""
select trans_key, amt, category, null as state from tx where floor(unix_time / 86400) % 2 = 0
union all select trans_key, amt, category, state from tx where floor(unix_time / 86400) % 2 = 1"""))
def union_batches(spark, sf):
    t = fx.tx(spark, sf)
    day = F.floor(F.col("unix_time") / 86400) % 2
    return rd.union_batches([t.where(day == 0).select("trans_key", "amt", "category"),
                             t.where(day == 1).select("trans_key", "amt", "category", "state")])


METRIC_ROWS = f""", b as ({fx.TX_BATCHES_SQL}),
h as (select * replace (coalesce(category, 'unknown') as category, coalesce(state, 'unknown') as state) from b where fraud_score >= 0.52),
tot as (select batch_id, max(batch_ts) as ts, count(*) as n, sum(cast(amt as decimal(18,2))) as amount,
               count(case when fraud_score >= 0.52 then 1 end) as flagged,
               coalesce(sum(case when fraud_score >= 0.52 then cast(amt as decimal(18,2)) end), 0) as flagged_amount,
               count(case when fraud_score < 0.6 then 1 end) as band_low,
               count(case when fraud_score >= 0.6 and fraud_score < 0.9 then 1 end) as band_medium,
               count(case when fraud_score >= 0.9 then 1 end) as band_high
        from b group by batch_id),
m as (
  select batch_id, 'total_txns_scored' as name, 'counter' as kind, cast(n as decimal(38,6)) as value, ts from tot
  union all select batch_id, 'total_amount_processed', 'counter', cast(amount as decimal(38,6)), ts from tot
  union all select batch_id, 'fraud_blocked_count', 'counter', cast(flagged as decimal(38,6)), ts from tot
  union all select batch_id, 'total_fraud_amount_identified', 'counter', cast(flagged_amount as decimal(38,6)), ts from tot
  union all select batch_id, 'fraud_dist_low', 'counter', cast(band_low as decimal(38,6)), ts from tot
  union all select batch_id, 'fraud_dist_medium', 'counter', cast(band_medium as decimal(38,6)), ts from tot
  union all select batch_id, 'fraud_dist_high', 'counter', cast(band_high as decimal(38,6)), ts from tot
  union all select batch_id, 'last_batch_size', 'gauge', cast(n as decimal(38,6)), ts from tot
  union all select batch_id, 'category_' || category || '_count', 'counter', cast(count(*) as decimal(38,6)), max(batch_ts) from h group by batch_id, category
  union all select batch_id, 'category_' || category || '_amount', 'counter', cast(sum(cast(amt as decimal(18,2))) as decimal(38,6)), max(batch_ts) from h group by batch_id, category
  union all select batch_id, 'category_' || category || '_score_sum', 'counter', cast(sum(cast(fraud_score as decimal(12,4))) as decimal(38,6)), max(batch_ts) from h group by batch_id, category
  union all select batch_id, 'state_' || state || '_count', 'counter', cast(count(*) as decimal(38,6)), max(batch_ts) from h group by batch_id, state
  union all select batch_id, 'state_' || state || '_amount', 'counter', cast(sum(cast(amt as decimal(18,2))) as decimal(38,6)), max(batch_ts) from h group by batch_id, state),
folded as (select name, kind, case when kind = 'counter' then sum(value) else arg_max(value, (ts, batch_id)) end as value,
                  cast(count(*) as bigint) as n_batches from m group by name, kind)"""


def _folded(spark, sf, prefix=""):
    return ct.metric_fold(ct.batch_counters(fx.tx_batches(spark, sf)), prefix)


@register("metric_fold", with_tx(METRIC_ROWS + "\nselect name, kind, cast(value as double) as value, n_batches from folded"))
def metric_fold(spark, sf):
    return _folded(spark, sf).withColumn("value", F.col("value").cast("double"))


@register("metric_fold_prefix", with_tx(METRIC_ROWS + """
select name, kind, cast(value as double) as value, n_batches from folded where starts_with(name, 'state_')"""))
def metric_fold_prefix(spark, sf):
    return _folded(spark, sf, "state_").withColumn("value", F.col("value").cast("double"))


@register("category_avg_score", with_tx(METRIC_ROWS + """
select regexp_extract(name, '^category_(.*)_(score_sum|count)$', 1) as category,
  cast(sum(case when regexp_extract(name, '^category_(.*)_(score_sum|count)$', 2) = 'score_sum' then value end) as double)
  / cast(sum(case when regexp_extract(name, '^category_(.*)_(score_sum|count)$', 2) = 'count' then value end) as double) as avg_score
from folded where regexp_matches(name, '^category_.*_(score_sum|count)$') group by 1"""))
def category_avg_score(spark, sf):
    return ct.category_avg_score(_folded(spark, sf))


EXPO_VALUES = ", ".join(f"({i}, '{n}', '{h}', '{t}', '{s}')" for i, (n, h, t, s) in enumerate(ct.EXPOSITION))


@register("exposition_lines", with_tx(METRIC_ROWS + f""",
spec as (select * from (values {EXPO_VALUES}) s(idx, name, help, type, source)),
j as (select spec.*, coalesce(folded.value, 0) as v from spec left join folded on folded.name = spec.source),
t as (select idx, name, help, type,
             case when v = floor(v) then cast(cast(floor(v) as bigint) as varchar)
                  else regexp_replace(cast(cast(v as decimal(38,6)) as varchar), '0+$', '') end as vt from j)
select cast(idx * 3 as int) as pos, '# HELP ' || name || ' ' || help as line from t
union all select cast(idx * 3 + 1 as int), '# TYPE ' || name || ' ' || type from t
union all select cast(idx * 3 + 2 as int), name || ' ' || vt from t"""))
def exposition_lines(spark, sf):
    return ct.exposition_lines(_folded(spark, sf))


def _run_folders(spark, sf):
    """lineitem written as ``topic=<return flag>/run=<ship year>`` folders."""
    path = checkpoint_path(spark, "run-folders", uuid.uuid4().hex)
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows = li.select("l_orderkey", "l_quantity", F.col("l_returnflag").alias("topic"), F.date_format("l_shipdate", "yyyy").alias("run"))
    rows.write.partitionBy("topic", "run").parquet(path)
    return path


@register("file_listing", """
select l_returnflag as topic, strftime(l_shipdate, '%Y') as run, cast(count(*) as bigint) as rows, true as filled
from lineitem group by 1, 2""")
def file_listing(spark, sf):
    """File table of written run folders, summed per run (how many files a run has depends on the cluster)."""
    files = rd.list_files(spark, _run_folders(spark, sf))
    return files.groupBy("topic", "run").agg(F.sum("rows").cast("bigint").alias("rows"),
                                             ((F.min("bytes") > 0) & (F.count("mtime") == F.count(F.lit(1)))).alias("filled"))


@register("storage_bytes", """
select 'topic=' || l_returnflag as directory, cast(count(*) as bigint) as rows, true as same_bytes from lineitem group by 1""")
def storage_bytes(spark, sf):
    """Folders with all that lies below them, held against the file table of the same folder."""
    path = _run_folders(spark, sf)
    listed = rd.list_files(spark, path).groupBy(F.concat(F.lit("topic="), "topic").alias("directory")).agg(
        F.sum("rows").cast("bigint").alias("rows"), F.sum("bytes").alias("listed"))
    sizes = rd.storage_bytes(spark, path).where(F.col("directory") != "")  # the commit marker lies in the root
    return sizes.join(listed, "directory", "full").select("directory", "rows", (F.col("bytes") == F.col("listed")).alias("same_bytes"))


# Hours each topic is kept.
RETENTION_HOURS = [("raw-transactions", 24), ("features-ready", 12), ("inference-results", 6), ("training-queue", 48)]


@register("retention_by_topic", f"""with {FILES},
lim as (select * from (values {", ".join(f"('{t}', {h})" for t, h in RETENTION_HOURS)}) l(topic, hours))
select topic, run, file, rows, bytes, mtime from files join lim using (topic)
where mtime >= (select max(mtime) from files where topic = 'raw-transactions') - to_hours(hours)""")
def retention_by_topic(spark, sf):
    """Files younger than their topic's limit, at the time of the newest raw file."""
    files = fx.run_files(spark, sf)
    now = files.where(F.col("topic") == "raw-transactions").agg(F.max("mtime")).first()[0]
    limits = spark.createDataFrame(RETENTION_HOURS, "topic string, hours int")
    return rd.retention_by_topic(files, limits, F.lit(now).cast("timestamp_ntz"), "mtime")


RAW_FROM_TX = [
    ("unix_time", "unix_time"), ("cc_num", "cc_num"), ("merchant", "merchant"), ("category", "category"),
    ("amt", "cast(cast(amt as double) as float)"), ("first", "first"), ("last", "last"), ("gender", "gender"),
    ("state", "state"), ("zip", "zip"), ("lat", "cast(lat as float)"), ("long", "cast(lon as float)"),
    ("city_pop", "city_pop"), ("merch_lat", "cast(merch_lat as float)"), ("merch_long", "cast(merch_lon as float)"),
    ("is_fraud", "cast(is_fraud as tinyint)"), ("merch_zipcode", "merch_zipcode"),
]


@register("read_transactions", with_tx("select " + ", ".join(f"{e} as {a}" for a, e in RAW_FROM_TX)
                                       + ", null as street, null as city, null as job, null as dob, null as trans_num from tx"))
def read_transactions(spark, sf):
    """S1 + S11: a run written as snappy parquet in the raw layout (some raw
    columns absent), read back with the fixed raw schema."""
    from ..sources.sinks import write_parquet_snappy
    path = checkpoint_path(spark, "runs", f"run_{uuid.uuid4().hex}")
    write_parquet_snappy(fx.tx(spark, sf).selectExpr(*[f"{e} as {a}" for a, e in RAW_FROM_TX]), path, "overwrite")
    return rd.read_transactions(spark, f"{path}/*.parquet")


@register("read_features", "select l_orderkey, l_quantity, l_discount, l_shipdate from lineitem")
def read_features(spark, sf):
    """The wanted columns that exist (``l_missing`` is skipped), pruned at the scan."""
    return rd.read_features(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_missing", "l_discount", "l_shipdate"])


@register("snapshot_json", REGISTRY["business_summary"][1])
def snapshot_json(spark, sf):
    """The business summary written as a JSON document and read back."""
    from ..operators.risk import business_summary
    from ..sources.sinks import snapshot_json as write_snapshot
    path = checkpoint_path(spark, "snapshots", uuid.uuid4().hex)
    summary = business_summary(fx.tx(spark, sf))
    write_snapshot(summary, path)
    return spark.read.schema(summary.schema).json(path)
