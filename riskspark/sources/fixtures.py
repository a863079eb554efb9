"""Stand-in inputs built from the test tables (see FIXTURES.md).

The library's jobs expect transaction rows, metric samples, log lines and
file listings; the test data is a TPC-H-like star schema plus an ``events``
table.  Each builder here only reshapes test rows into the schema a job
expects -- it does none of the job's work -- and each has a DuckDB twin
(``*_sql``) so that the oracle queries read exactly the same input.

Column expressions are written once as SQL text and used by both engines
(Spark ``selectExpr`` / DuckDB ``SELECT``); only the epoch conversion differs.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


# --------------------------------------------------------------------------
# Fixed values of the transaction domain: the 14 merchant categories.
# --------------------------------------------------------------------------
CATEGORIES = [
    "gas_transport", "grocery_pos", "misc_pos", "misc_net", "shopping_net",
    "shopping_pos", "grocery_net", "entertainment", "food_dining", "home",
    "kids_pets", "travel", "health_fitness", "personal_care",
]


def _category_case(col: str) -> str:
    whens = " ".join(f"when {i} then '{c}'" for i, c in enumerate(CATEGORIES[:-1]))
    return f"case {col} % {len(CATEGORIES)} {whens} else '{CATEGORIES[-1]}' end"


# (alias, expression); ``{epoch}`` is the engine's seconds-since-epoch of l_shipdate.
TX_COLUMNS: list[tuple[str, str]] = [
    ("trans_key", "l_orderkey*1000003 + l_partkey*101 + l_suppkey*7 + l_linenumber"),
    ("unix_time", "cast({epoch} + (l_partkey*7919 + l_orderkey*104729 + l_linenumber*3571) % 86400 as bigint)"),
    ("cc_num", "4000000000000000 + o_custkey"),
    ("merchant", "s_name"),
    ("category", _category_case("l_partkey")),
    ("amt", "cast(l_extendedprice as decimal(18,2))"),
    ("first", "c_name"),
    ("last", "c_mktsegment"),
    ("state", "n_name"),
    ("gender", "case when o_custkey % 2 = 0 then 'M' else 'F' end"),
    ("zip", "cast(10000 + (o_custkey*31) % 89999 as int)"),
    ("city_pop", "cast(1000 + (o_custkey*104729) % 1999000 as int)"),
    ("lat", "25 + cast(o_custkey*7919 % 2300 as double) / 100"),
    ("lon", "-125 + cast(o_custkey*104729 % 5500 as double) / 100"),
    ("merch_lat", "25 + cast(o_custkey*7919 % 2300 as double) / 100 + cast(l_suppkey % 201 - 100 as double) / 100"),
    ("merch_lon", "-125 + cast(o_custkey*104729 % 5500 as double) / 100 + cast(l_partkey % 201 - 100 as double) / 100"),
    ("merch_zipcode", "cast(10000 + (l_suppkey*53) % 89999 as int)"),
    ("is_fraud", "case when l_returnflag = 'R' and l_discount >= 0.09 then 1 else 0 end"),
    ("fraud_score", "round(case when l_returnflag = 'R' then 0.35 else 0.0 end + l_discount*4.0 + cast(l_partkey % 100 as double) / 400, 4)"),
]

SPARK_EPOCH = "unix_timestamp(l_shipdate)"
DUCK_EPOCH = "cast(epoch(l_shipdate) as bigint)"


def ntz_as_utc(c: str):
    """A TIMESTAMP_NTZ wall clock read as UTC, whatever the session time zone."""
    return F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone())


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a stored file, about; larger inputs get more files.
ROWS_PER_FILE = 1_000_000
#: Suppliers up to this number are broadcast (a key and a name each).
FEW_SUPPLIERS = 500_000

_STORED: dict[tuple[str, str, str], str] = {}
_STORED_LOCK = threading.RLock()


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stand-in input as a stored table: built once per application and
    written as parquet into the shared checkpoint folder, then read back.

    Jobs meet their inputs as stored data (transactions after scoring, log
    files, metric stores, file listings), so queries read a columnar table
    with pushdown instead of re-running the reshaping on every pass.
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    with _STORED_LOCK:  # one build per input, also when queries run from several threads
        return spark.read.parquet(_stored_path(spark, key, build))


def _stored_path(spark: SparkSession, key: tuple[str, str, str], build) -> str:
    from ..session import checkpoint_path, conf_override
    sf_dir, name = key[1], key[2]  # key = (application id, input folder, input name)
    path = _STORED.get(key)
    if path is None:
        import hashlib
        tag = hashlib.sha1(key[1].encode()).hexdigest()[:12]
        path = checkpoint_path(spark, "inputs", f"{name}-{tag}-{key[0]}")
        parts = max(1, spark.sparkContext.defaultParallelism)
        df, rows = build(spark, sf_dir), _read(spark, sf_dir, "lineitem").count() if name == "tx" else 0
        if rows <= parts * ROWS_PER_FILE:
            # one file per task slot, so that reading the stored table is parallel
            # (the small test files hold a single row group each)
            df = df.repartition(parts)
        else:  # rows stay where the join on the order key left them: the wide rows are not shuffled again
            parts = -(-rows // ROWS_PER_FILE)
        # what the build shuffles goes when the table is written, not when the driver happens to collect its garbage
        with (conf_override(spark, "spark.sql.shuffle.partitions", str(parts)),
              conf_override(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")):
            df.write.mode("overwrite").option("compression", "snappy").parquet(path)
        _STORED[key] = path
    return path


def tx_folder(spark: SparkSession, sf_dir: str) -> str:
    """The folder of parquet files in which ``tx`` is stored."""
    tx(spark, sf_dir)
    return _STORED[spark.sparkContext.applicationId, sf_dir.rstrip("/"), "tx"]


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored transactions as a stored table, as the scoring stage leaves them (see ``build_tx``)."""
    return stored(spark, sf_dir, "tx", build_tx)


def build_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions (raw schema + rule score) from lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ supplier.

    Orders get their customer first, which is the smaller of the large joins; lineitem meets them in one equi-join
    (shuffle on the order key), the only one that moves its rows.  Up to ``FEW_SUPPLIERS`` suppliers (counted) are
    broadcast; more are left to Catalyst/AQE, as are customer and nation.
    """
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_discount", "l_returnflag", "l_shipdate")
    od = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    na = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    su = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    if su.count() <= FEW_SUPPLIERS:
        su = F.broadcast(su)
    ordered = (od.join(cu, F.col("o_custkey") == cu.c_custkey)
                 .join(na, F.col("c_nationkey") == na.n_nationkey))
    joined = (li.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(su, F.col("l_suppkey") == F.col("s_suppkey")))
    return joined.selectExpr(*[f"{e.format(epoch=SPARK_EPOCH)} as {a}" for a, e in TX_COLUMNS])


def tx_sql() -> str:
    cols = ",\n  ".join(f"{e.format(epoch=DUCK_EPOCH)} as {a}" for a, e in TX_COLUMNS)
    return (f"select\n  {cols}\nfrom lineitem\njoin orders on l_orderkey = o_orderkey\n"
            "join customer on o_custkey = c_custkey\njoin nation on c_nationkey = n_nationkey\n"
            "join supplier on l_suppkey = s_suppkey")


# --------------------------------------------------------------------------
# Metric samples (gauge and counter) from events.
# --------------------------------------------------------------------------
# Fixed label values used by the metric-sample fixture.
CPU_MODES = ["idle", "user", "iowait", "system"]
DIMENSIONS = ["read_bytes_per_sec", "write_bytes_per_sec"]

GAUGE_COLUMNS: list[tuple[str, str]] = [
    ("metric", "event_type"),
    ("instance", "cast(user_id % 10 as string)"),
    ("cpu", "cast(user_id % 8 as string)"),
    ("mode", "case user_id % 4 when 0 then 'idle' when 1 then 'user' when 2 then 'iowait' else 'system' end"),
    ("dimension", "case when event_id % 2 = 0 then 'read_bytes_per_sec' else 'write_bytes_per_sec' end"),
    ("ts", "from_utc_timestamp(cast(ts as timestamp), current_timezone())"),
    ("value", "cast(floor(value * 100) as double)"),
    ("event_id", "event_id"),
]


def _samples_with_labels(df: DataFrame) -> DataFrame:
    return df.select(
        "metric",
        F.create_map(F.lit("instance"), "instance", F.lit("cpu"), "cpu",
                     F.lit("mode"), "mode", F.lit("dimension"), "dimension").alias("labels"),
        "ts", "value", "event_id")


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form of ``build_gauge_samples``."""
    return stored(spark, sf_dir, "gauge_samples", build_gauge_samples)


def build_gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric_samples(metric, labels, ts, value) -- one gauge sample per event."""
    ev = _read(spark, sf_dir, "events")
    return _samples_with_labels(ev.selectExpr(*[f"{e} as {a}" for a, e in GAUGE_COLUMNS]))


def gauge_samples_sql() -> str:
    cols = ", ".join(f"{e.replace(' as string', ' as varchar').replace('from_utc_timestamp(cast(ts as timestamp), current_timezone())', 'ts')} as {a}"
                     for a, e in GAUGE_COLUMNS)
    return f"select {cols} from events"


COUNTER_RESTART = 50


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form of ``build_counter_samples``."""
    return stored(spark, sf_dir, "counter_samples", build_counter_samples)


def build_counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples: running sum of floor(value*100) per (event_type, user_id),
    restarted every 50th sample so that the series contains resets."""
    ev = _read(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id", ntz_as_utc("ts").alias("ts"),
        F.floor(F.col("value") * 100).cast("bigint").alias("inc"))
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    ev = ev.withColumn("seg", F.floor((F.row_number().over(w) - 1) / COUNTER_RESTART))
    w2 = (Window.partitionBy("event_type", "user_id", "seg").orderBy("ts", "event_id")
          .rowsBetween(Window.unboundedPreceding, 0))
    ev = ev.withColumn("value", F.sum("inc").over(w2).cast("double"))
    return ev.select(
        F.concat(F.col("event_type"), F.lit("_total")).alias("metric"),
        F.create_map(F.lit("instance"), F.col("user_id").cast("string"),
                     F.lit("cpu"), (F.col("user_id") % 8).cast("string"),
                     F.lit("mode"), F.element_at(F.array(*[F.lit(m) for m in CPU_MODES]),
                                                 (F.col("user_id") % 4 + 1).cast("int"))).alias("labels"),
        "ts", "value", "event_id")


def counter_samples_sql() -> str:
    return f"""select event_type || '_total' as metric, cast(user_id as varchar) as instance,
  cast(user_id % 8 as varchar) as cpu,
  case user_id % 4 when 0 then 'idle' when 1 then 'user' when 2 then 'iowait' else 'system' end as mode,
  ts, event_id,
  cast(sum(inc) over (partition by event_type, user_id, seg order by ts, event_id
                      rows between unbounded preceding and current row) as double) as value
from (select *, floor((row_number() over (partition by event_type, user_id order by ts, event_id) - 1) / {COUNTER_RESTART}) as seg
      from (select event_id, event_type, user_id, ts, cast(floor(value*100) as bigint) as inc from events))"""


def poll_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form of ``build_poll_ticks``."""
    return stored(spark, sf_dir, "poll_ticks", build_poll_ticks)


def build_poll_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll ticks (series, tick, value): per (event_type, hour) the cumulative
    number of events up to the end of that hour -- a monotone counter store."""
    ev = _read(spark, sf_dir, "events").select(
        "event_type", F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("tick"))
    per_hour = ev.groupBy("event_type", "tick").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return per_hour.select(F.col("event_type").alias("series"), "tick",
                           F.sum("n").over(w).cast("double").alias("value"))


def poll_ticks_sql() -> str:
    return """select event_type as series, tick,
  cast(sum(n) over (partition by event_type order by tick rows between unbounded preceding and current row) as double) as value
from (select event_type, date_trunc('hour', ts) as tick, count(*) as n from events group by 1, 2)"""


# --------------------------------------------------------------------------
# Text fixtures.
# --------------------------------------------------------------------------
# Fixed stage names of the four pipeline stages.
STAGES = ["Ingest", "Data Prep", "Model Train", "Inference"]
TELEMETRY_LINE = (
    "case when event_id % 13 = 5 then concat('INFO | heartbeat ', cast(event_id as {s})) else concat("
    "'[TELEMETRY] stage=', case user_id % 4 when 0 then 'Ingest' when 1 then 'Data Prep' "
    "when 2 then 'Model Train' else 'Inference' end, "
    "' | status=', case when event_id % 5 = 0 then 'Completed' else 'Running' end, "
    "' | rows=', case when event_id % 97 = 0 then concat(cast(event_id * 10 as {s}), 'x') else cast(event_id * 10 as {s}) end, "
    "' | throughput=', cast(cast(floor(value * 100) as bigint) as {s}), "
    "' | elapsed=', cast(user_id as {s}), "
    "' | cpu_cores=', cast(user_id % 16 as {s}), "
    "' | ram_gb=', cast(user_id % 64 as {s}), "
    "' | ram_percent=', cast(event_id % 100 as {s}), "
    "' | fraud_blocked=', cast(event_id % 7 as {s}), "
    "' | cpu_tps=', cast(event_id % 1000 as {s})) end")
TELEMETRY_LOG = "'pipeline_report'"


def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form of ``build_telemetry_lines``."""
    return stored(spark, sf_dir, "telemetry_lines", build_telemetry_lines)


def build_telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines (log, line_no, line) of one report file, numbered without gaps;
    most carry a [TELEMETRY] record, every 13th is a plain log line and every
    97th has a bad number."""
    ev = _read(spark, sf_dir, "events")
    return ev.selectExpr(f"{TELEMETRY_LOG.format(s='string')} as log", "event_id as line_no",
                         f"{TELEMETRY_LINE.format(s='string')} as line")


def telemetry_lines_sql() -> str:
    return (f"select {TELEMETRY_LOG.format(s='varchar')} as log, event_id as line_no, "
            f"{TELEMETRY_LINE.format(s='varchar')} as line from events")


USAGE_LINE = ("concat(lower(s_name), '-7d9f-x2k4  ', cast(s_suppkey*37 % 4000 as {s}), 'm  ', "
              "cast(s_suppkey*53 % 9000 as {s}), 'Mi')")


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kubectl top pods`` style lines: ``<deploy>-<hash>-<suffix>  100m  250Mi``."""
    return _read(spark, sf_dir, "supplier").selectExpr(f"{USAGE_LINE.format(s='string')} as line")


def usage_lines_sql() -> str:
    return f"select {USAGE_LINE.format(s='varchar')} as line from supplier"


QUANTITY_CPU = ("case s_suppkey % 3 when 0 then concat(cast(s_suppkey % 64 as {s}), '') "
                "when 1 then concat(cast(s_suppkey * 37 % 64000 as {s}), 'm') else 'bad' end")
QUANTITY_MEM = ("case s_suppkey % 12 when 0 then concat(cast(s_suppkey * 53 % 90000 as {s}), 'Ki') "
                "when 1 then concat(cast(s_suppkey % 9000 as {s}), 'Mi') "
                "when 2 then concat(cast(s_suppkey % 64 as {s}), 'Gi') "
                "when 3 then cast(s_suppkey * 11 % 100000 as {s}) "
                "when 4 then concat(cast(s_suppkey % 9 as {s}), 'Ti') "
                "when 5 then concat(cast(s_suppkey * 7 % 9000 as {s}), 'k') "
                "when 6 then concat(cast(s_suppkey % 9000 as {s}), 'M') "
                "when 7 then concat(cast(s_suppkey % 64 as {s}), 'g') "
                "when 8 then concat(cast(s_suppkey % 5 as {s}), 'T') "
                "when 9 then concat(cast(s_suppkey % 700 as {s}), 'mI') "
                "when 10 then concat(cast(s_suppkey as {s}), '.5Gi') "
                "else concat(cast(s_suppkey as {s}), '9999999999', 'gi') end")


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource quantity strings (cpu, memory) in the unit forms seen in node listings."""
    return _read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as id", f"{QUANTITY_CPU.format(s='string')} as cpu",
        f"{QUANTITY_MEM.format(s='string')} as memory")


def quantities_sql() -> str:
    return (f"select s_suppkey as id, {QUANTITY_CPU.format(s='varchar')} as cpu, "
            f"{QUANTITY_MEM.format(s='varchar')} as memory from supplier")


# --------------------------------------------------------------------------
# File listings, ledgers, topics.
# --------------------------------------------------------------------------
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form of ``build_run_files``."""
    return stored(spark, sf_dir, "run_files", build_run_files)


def build_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File table (topic, run, file, rows, bytes, mtime): run = ship month,
    file = supplier key mod 8; topic by file number."""
    li = _read(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        (F.col("l_suppkey") % 8).alias("f"), "l_linenumber")
    g = li.groupBy("month", "f").agg(F.count("*").alias("rows"),
                                     (F.sum("l_linenumber") * 1000).alias("bytes"))
    return g.select(
        F.element_at(F.array(*[F.lit(t) for t in TOPICS]), (F.col("f") % 4 + 1).cast("int")).alias("topic"),
        F.concat(F.lit("run_"), "month").alias("run"),
        F.format_string("worker_%d.parquet", "f").alias("file"),
        F.col("rows").cast("bigint").alias("rows"), F.col("bytes").cast("bigint").alias("bytes"),
        (F.to_timestamp_ntz(F.concat("month", F.lit("-01"))) + F.make_dt_interval(F.lit(0), F.col("f").cast("int"))).alias("mtime"))


def run_files_sql() -> str:
    return """select case f % 4 when 0 then 'raw-transactions' when 1 then 'features-ready'
    when 2 then 'inference-results' else 'training-queue' end as topic,
  'run_' || month as run, 'worker_' || cast(f as varchar) || '.parquet' as file,
  cast(rows as bigint) as rows, cast(bytes as bigint) as bytes,
  cast(month || '-01' as timestamp) + to_hours(cast(f as bigint)) as mtime
from (select strftime(l_shipdate, '%Y-%m') as month, l_suppkey % 8 as f, count(*) as rows,
             sum(l_linenumber) * 1000 as bytes from lineitem group by 1, 2)"""


def run_ledger(files: DataFrame) -> DataFrame:
    """Ledger of processed runs: every run whose month number is odd."""
    return (files.select("run").distinct()
            .where((F.substring("run", 10, 2).cast("int") % 2) == 1))


RUN_LEDGER_SQL = "select distinct run from files where cast(substr(run, 10, 2) as int) % 2 = 1"

FILE_LEDGER_SQL = "select file, run from files where (rows % 3) = 0"


def file_ledger(files: DataFrame) -> DataFrame:
    """Ledger of consumed files: every file whose row count is a multiple of 3."""
    return files.where(F.col("rows") % 3 == 0).select("file", "run")


# The four queue topics and their limits (warning, critical, action).
TOPICS = ["raw-transactions", "features-ready", "inference-results", "training-queue"]
QUEUE_LIMITS = [
    ("raw-transactions", 1_500_000, 3_000_000, "throttle_generation"),
    ("features-ready", 250_000, 500_000, "scale_inference"),
    ("inference-results", 100_000, 200_000, "alert_only"),
    ("training-queue", None, 5_000, None),
]


def queue_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUEUE_LIMITS, "topic string, warning long, critical long, action string")


def queue_limits_sql() -> str:
    rows = ", ".join(
        "(" + ", ".join("null" if v is None else (f"'{v}'" if isinstance(v, str) else str(v)) for v in r) + ")"
        for r in QUEUE_LIMITS)
    return (f"select topic, cast(warning as bigint) as warning, cast(critical as bigint) as critical, action "
            f"from (values {rows}) t(topic, warning, critical, action)")


METRICS_LINE = ("case when event_id % 3 = 0 then concat('METRICS: Rows=', cast(event_id * 10 as {s}), ' | Time=', "
                "cast(user_id as {s}), '.', cast(event_id % 100 as {s}), 's | Throughput=', cast(cast(floor(value * 100) as bigint) as {s}), "
                "'.', cast(event_id % 10 as {s}), ' rows/s') else concat('METRICS: CPU=', cast(user_id % 16 as {s}), '.0 Cores') end")


def metrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form of ``build_metrics_lines``."""
    return stored(spark, sf_dir, "metrics_lines", build_metrics_lines)


def build_metrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final summary lines: ``METRICS: Rows=.. | Time=..s | Throughput=.. rows/s`` and CPU lines."""
    return _read(spark, sf_dir, "events").selectExpr("event_id as line_no", f"{METRICS_LINE.format(s='string')} as line")


def metrics_lines_sql() -> str:
    return f"select event_id as line_no, {METRICS_LINE.format(s='varchar')} as line from events"


# --------------------------------------------------------------------------
# Transactions as text with bad values, and replayed batches.
# --------------------------------------------------------------------------
TEXT_TX = [
    ("trans_key", "cast(trans_key as {s})"),
    ("unix_time", "cast(unix_time as {s})"),
    ("cc_num", "cast(cc_num as {s})"),
    ("category", "case when trans_key % 307 = 0 then null else category end"),
    ("amt", "case when trans_key % 211 = 0 then 'x' else cast(amt as {s}) end"),
    ("state", "state"),
]


def tx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as strings (as a text feed delivers them): every 211th
    amount is not a number and every 307th category is missing."""
    return tx(spark, sf_dir).selectExpr(*[f"{e.format(s='string')} as {a}" for a, e in TEXT_TX])


def tx_text_sql() -> str:
    return "select " + ", ".join(f"{e.format(s='varchar')} as {a}" for a, e in TEXT_TX) + " from tx"


def tx_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a republished batch: rows with trans_key % 20 = 0 appear twice."""
    return tx(spark, sf_dir).unionByName(tx_republished(spark, sf_dir))


def tx_republished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The republished batch of ``tx_replayed``."""
    return tx(spark, sf_dir).where(F.col("trans_key") % 20 == 0)


TX_REPLAYED_SQL = "select * from tx union all select * from tx where trans_key % 20 = 0"


def tx_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored transactions cut into daily batches (batch_id = day number) with
    the batch's end time, as a scorer would see them."""
    t = tx(spark, sf_dir)
    b = F.floor(F.col("unix_time") / 86400)
    return t.withColumn("batch_id", b).withColumn("batch_ts", F.timestamp_seconds((b + 1) * 86400))


TX_BATCHES_SQL = ("select *, floor(unix_time / 86400) as batch_id, "
                  "make_timestamp(cast((floor(unix_time / 86400) + 1) * 86400 as bigint) * 1000000) as batch_ts from tx")
