"""Streaming queries: each stages its input as parquet files in the shared
checkpoint folder, runs the stream to the end (``availableNow``, one file per
micro-batch) and returns what the sink wrote.  Where the streamed result must
equal a batch result, the batch query's SQL is the oracle."""

from __future__ import annotations

import uuid
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import build_features
from ..operators import counters as ct
from ..operators import ml
from ..session import checkpoint_path, conf_override
from ..sources import fixtures as fx
from ..sources import folders, metric_store
from ..streaming import streams as st
from ..streaming.files import audited_stream, stream_in_name_order
from ..streaming.velocity import velocity_stream
from .catalog import REGISTRY, register, with_tx
from .q_features import R9
from .q_sources import METRIC_ROWS

FILES = 4
MANY = 1_000_000  # files per trigger: all of a delivery
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else each new row is looked up twice
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def _scratch(spark: SparkSession, name: str) -> str:
    return checkpoint_path(spark, "streams", f"{name}-{uuid.uuid4().hex}")


def _replay(df: DataFrame, path: str, order: str, start, files: int = FILES) -> None:
    """Deliver the input as ``files`` ranges of the ``order`` column, one after another, and run the stream to its
    end after each, as a job that is started again whenever data came: ranges arrive in time order, rows of a
    range in any order and number of files."""
    num = F.unix_micros(F.col(order)) if dict(df.dtypes)[order].startswith("timestamp") else F.col(order)
    d = df.withColumn("_stage_k", num)
    cuts = d.approxQuantile("_stage_k", [i / files for i in range(1, files)], 0.001)
    bounds = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = d
        if lo is not None:
            part = part.where(F.col("_stage_k") >= lo)
        if hi is not None:  # rows without a time come with the first range
            early = F.col("_stage_k") < hi
            part = part.where(early | F.col("_stage_k").isNull() if lo is None else early)
        part.drop("_stage_k").write.mode("append").parquet(path)
        st.run_to_end(start)


def _deliver(df: DataFrame, path: str, batches: int = FILES) -> int:
    """Deliver the input as parquet files in no order: times mix in every file.  Gives the files to take per trigger for
    ``batches`` micro-batches: one, or as many as keep a file at about ``fx.ROWS_PER_FILE`` rows."""
    each = _files_for(df.count(), batches)
    df.repartition(batches * each).write.parquet(path)
    return each


def _raw(spark: SparkSession, sf: str, base: str) -> tuple[str, int]:
    """Raw transactions as a folder of files, and the files to take per trigger for ``FILES`` micro-batches: the stored
    transactions as they lie there, times mixed in every file; only if these are too few files are they delivered anew."""
    path = fx.tx_folder(spark, sf)
    files = sum(name.endswith(".parquet") for name in folders.names(spark, path))
    if files < FILES:
        return f"{base}/raw", _deliver(fx.tx(spark, sf).drop("fraud_score"), f"{base}/raw")
    return path, -(-files // FILES)


def _replayed(spark: SparkSession, sf: str, base: str) -> tuple[str, int]:
    """``fx.tx_replayed`` as ``_raw`` gives the transactions: the stored ones as they lie there, and the republished rows, one in
    twenty, delivered beside them."""
    root, stored = checkpoint_path(spark), fx.tx_folder(spark, sf)
    files = sum(name.endswith(".parquet") for name in folders.names(spark, stored))
    if files < FILES or not stored.startswith(f"{root}/") or set(root) & set("{}[]*?,\\"):  # the two folders are read as a pattern
        return f"{base}/src", _deliver(fx.tx_replayed(spark, sf), f"{base}/src")
    fx.tx_republished(spark, sf).coalesce(-(-files // 20)).write.parquet(f"{base}/again")
    files += sum(name.endswith(".parquet") for name in folders.names(spark, f"{base}/again"))
    return f"{root}/{{{stored.removeprefix(f'{root}/')},{base.removeprefix(f'{root}/')}/again}}", -(-files // FILES)


def _files_for(rows: int, batches: int = 1) -> int:
    return max(1, -(-rows // (batches * fx.ROWS_PER_FILE)))


def _foreach_append(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    return write


# the batch features are the streams' oracle
FEATURES_SQL = f"select * exclude (fraud_score) from ({REGISTRY['features_all'][1]})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.drop("batch_id").select(*[F.round(c, R9).alias(c) if c in ("amt_log", "distance_km", "city_pop_log") else F.col(c)
                                        for c in df.columns if c != "batch_id"])


@register("stream_features", FEATURES_SQL)
def stream_features(spark, sf):
    """Raw transactions -> feature stream -> queue + archive; the queue holds the batch job's features."""
    base = _scratch(spark, "features")
    raw, each = _raw(spark, sf, base)
    schema = fx.tx(spark, sf).drop("fraud_score").schema
    st.run_to_end(lambda: st.feature_stream(spark, raw, schema, f"{base}/queue", f"{base}/archive",
                                            f"{base}/ckpt", max_files=each, available_now=True))
    return _rounded(spark.read.parquet(f"{base}/queue"))


@register("dual_sink", FEATURES_SQL)
def dual_sink_query(spark, sf):
    """The archive copy written next to the queue by the feature stream."""
    base = _scratch(spark, "dual")
    raw, each = _raw(spark, sf, base)
    schema = fx.tx(spark, sf).drop("fraud_score").schema
    st.run_to_end(lambda: st.feature_stream(spark, raw, schema, f"{base}/queue", f"{base}/archive",
                                            f"{base}/ckpt", max_files=each, available_now=True))
    return _rounded(spark.read.parquet(f"{base}/archive"))


def _scoring_run(spark, sf) -> str:
    base = _scratch(spark, "scores")
    feats = build_features(fx.tx(spark, sf).drop("fraud_score"))
    train, _ = ml.ordered_split(feats, 0.2, ["unix_time", "trans_key"])
    ml.register_model(ml.fit_risk_model(train, None), f"{base}/models")
    each = _deliver(feats, f"{base}/features")
    schema = spark.read.parquet(f"{base}/features").schema
    st.run_to_end(lambda: st.score_stream(spark, f"{base}/features", schema, f"{base}/models", f"{base}/results",
                                          f"{base}/metrics", f"{base}/ckpt", max_files=each, available_now=True))
    return base


@register("stream_scores", None)
def stream_scores(spark, sf):
    """Feature stream scored by the newest registered model (held against the batch scores of that model
    in ``tests/test_ml.py``)."""
    return spark.read.parquet(f"{_scoring_run(spark, sf)}/results").select(
        "trans_key", "unix_time", "fraud_score", "fraud_prediction", "model_version", F.col("batch_id").cast("bigint").alias("batch_id"))


@register("stream_counters", with_tx(METRIC_ROWS + """
select name, cast(value as double) as value from folded
where kind = 'counter' and (name like 'total_%' or name like 'fraud_%')"""))
def stream_counters(spark, sf):
    """Counters written per micro-batch by a scoring stream, folded.  The
    stream is scored with the rule score (the scored column is replaced by the
    stand-in's ``fraud_score``) so the fold can be checked against SQL."""
    base = _scratch(spark, "counters")
    tx = fx.tx(spark, sf)
    each = _deliver(tx, f"{base}/scored")
    schema = spark.read.parquet(f"{base}/scored").schema

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = ct.batch_counters(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
                                 .withColumn("batch_ts", F.timestamp_seconds(F.lit(batch_id))))
        from ..sources.metric_store import write_metrics
        write_metrics(rows, f"{base}/metrics")

    def start():
        s = st.stream_parquet(spark, f"{base}/scored", schema, each)
        return s.writeStream.foreachBatch(process).option("checkpointLocation", f"{base}/ckpt") \
                .trigger(availableNow=True).start()

    st.run_to_end(start)
    folded = ct.metric_fold(spark.read.parquet(f"{base}/metrics"))
    return folded.where((F.col("kind") == "counter") & (F.col("name").startswith("total_") | F.col("name").startswith("fraud_"))) \
                 .select("name", F.col("value").cast("double").alias("value"))


@register("stream_ema", REGISTRY["ema"][1])
def stream_ema(spark, sf):
    """EMA with reset carried from micro-batch to micro-batch; equals the batch fold."""
    base = _scratch(spark, "ema")
    g = fx.gauge_samples(spark, sf).select("metric", "ts", "event_id", (F.col("value") * 20).alias("x"))

    def start():
        s = st.stream_parquet(spark, f"{base}/src", g.schema, MANY)
        return st.smooth_stream(s, ["metric"], ["ts", "event_id"], "x", f"{base}/out", f"{base}/state", f"{base}/ckpt", available_now=True)

    _replay(g, f"{base}/src", "ts", start)
    return spark.read.parquet(f"{base}/out").drop("batch_id")


@register("stream_velocity", REGISTRY["card_velocity"][1])
def stream_velocity(spark, sf):
    """F17/W8 on a stream: trailing hour per card, rows arriving up to 50 minutes late; equals the batch figures."""
    base = _scratch(spark, "velocity")
    tx = fx.tx(spark, sf).select("trans_key", "cc_num", "unix_time", "amt")
    late = F.pmod(F.xxhash64("trans_key"), F.lit(3000))
    arriving = tx.withColumn("arrival", F.col("unix_time") + late)

    def start():
        s = st.stream_parquet(spark, f"{base}/src", arriving.schema, MANY).drop("arrival")
        return st.sink_stage(velocity_stream(s, delay="1 hour"), f"{base}/out", f"{base}/ckpt", available_now=True)

    _replay(arriving, f"{base}/src", "arrival", start)
    # the stream ends here: one later row, of no card, moves the watermark past all others
    end = arriving.agg(F.max("unix_time").alias("t")).select(
        *[(F.col("t") + 86_400 if c in ("unix_time", "arrival") else F.lit(None)).cast(arriving.schema[c].dataType).alias(c) for c in arriving.columns])
    end.write.mode("append").parquet(f"{base}/src")
    st.run_to_end(start)
    out = spark.read.parquet(f"{base}/out").where("trans_key is not null").drop("amt")
    return out.withColumnsRenamed({"txn_count_3600s": "txn_count_1h", "amount_3600s": "amount_1h"})


@register("stream_name_order", """
select event_id, event_type, value, cast(floor((event_id % 7) / 2) as bigint) as batch_id from events""")
def stream_name_order(spark, sf):
    """Files written in reverse order of their names are taken in name order, two per micro-batch, the
    stream being started anew for each."""
    base = _scratch(spark, "names")
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value")
    for name in reversed(range(7)):
        one = f"{base}/one-{name}"
        ev.where(F.col("event_id") % 7 == name).coalesce(1).write.parquet(one)  # a file is what is delivered here
        folders.move_file(spark, one, ".parquet", f"{base}/src", f"batch-{name:04d}.parquet")

    def start():
        s = stream_in_name_order(spark, f"{base}/src", ev.schema, max_files=2)
        return s.writeStream.foreachBatch(_foreach_append(f"{base}/out")).option("checkpointLocation", f"{base}/ckpt") \
                .trigger(availableNow=True).start()

    for _ in range(5):  # the last one finds nothing new
        st.run_to_end(start)
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type", "value", F.col("batch_id").cast("bigint").alias("batch_id"))


@register("stream_audited", """
select l_orderkey, l_linenumber, l_quantity, 'row' as kind, cast(1 as bigint) as times from lineitem where l_linenumber <> 3
union all select null, null, null, 'broken file', cast(1 as bigint)""")
def stream_audited(spark, sf):
    """S13 on a stream: one folder of files, those of line number 3 cut off in the middle; the rows of the sound
    ones arrive, and the ledger lists each broken file once (here: one line for the files of a line number, with the times
    the one listed most often stands there).  A line number comes in files of about ``fx.ROWS_PER_FILE`` rows."""
    base = _scratch(spark, "audited")
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    schema = li.schema
    by_number = li.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    each = _files_for(by_number.where(F.col("l_linenumber").between(1, 7)).agg(F.max("n")).first()[0] or 0)

    def start():
        return audited_stream(spark, f"{base}/src", schema, _foreach_append(f"{base}/out"), f"{base}/ledger", f"{base}/ckpt",
                              max_files=3 * each, available_now=True)

    for n in range(1, 8):
        one = f"{base}/one-{n}"
        li.where(F.col("l_linenumber") == n).repartition(each).write.parquet(one)  # files are what is delivered here
        folders.move_files(spark, one, ".parquet", f"{base}/src", f"file-{n}", keep=0.5 if n == 3 else 1.0)
        if n in (2, 5, 7):
            st.run_to_end(start)
    rows = spark.read.parquet(f"{base}/out").select(*li.columns, F.lit("row").alias("kind"), F.lit(1).cast("bigint").alias("times"))
    listed = spark.read.parquet(f"{base}/ledger").groupBy("path").agg(F.count(F.lit(1)).alias("times"))
    broken = listed.groupBy(F.regexp_extract("path", r"file-(\d+)-\d+\.parquet$", 1)).agg(F.max("times").alias("times"))
    return rows.unionByName(broken.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], F.lit("broken file").alias("kind"), "times"))


MONTH = 30 * 86400


@register("metric_store_compacted", with_tx(METRIC_ROWS.replace("86400", str(MONTH)) + "\nselect name, kind, cast(value as double) as value, n_batches from folded"))
def metric_store_compacted(spark, sf):
    """The store written batch by batch, compacted on the way, with a closed and an open batch written
    again; the fold over base and open batches is the fold over all batches."""
    path = _scratch(spark, "store")
    b = F.floor(F.col("unix_time") / MONTH)
    tx = fx.tx(spark, sf).withColumn("batch_id", b).withColumn("batch_ts", F.timestamp_seconds((b + 1) * MONTH))
    rows = ct.batch_counters(tx).persist()
    try:
        ids = [r[0] for r in rows.select("batch_id").distinct().orderBy("batch_id").collect()]  # the batches of the stand-in
        third = max(1, len(ids) // 3)
        for part in (ids[:third], ids[third:2 * third], ids[2 * third:]):
            if not part:
                continue
            metric_store.write_metrics(rows.where(F.col("batch_id").isin(part)), path)
            metric_store.compact_metrics(spark, path, part[len(part) // 2])
        metric_store.write_metrics(rows.where(F.col("batch_id").isin([ids[0], ids[-1]])), path)
    finally:
        rows.unpersist()
    return ct.metric_fold(metric_store.read_metrics(spark, path)).withColumn("value", F.col("value").cast("double"))


@register("stream_dedupe", REGISTRY["dedupe_batches"][1])
def stream_dedupe(spark, sf):
    """Republished rows dropped within a one-day watermark on their arrival, in any order of event times."""
    base = _scratch(spark, "dedupe")
    schema = fx.tx(spark, sf).schema
    src, each = _replayed(spark, sf, base)

    def start():
        s = st.stream_parquet(spark, src, schema, each)
        cols = s.columns
        d = st.dedupe_stream(s, "1 day", cols)
        return st.sink_stage(d, f"{base}/out", f"{base}/ckpt", available_now=True)

    # the state holds every row: on disk, in partitions of bounded size, and only the versions that a restart needs
    with ExitStack() as stack:
        for key, value in STATE_ON_DISK.items():
            stack.enter_context(conf_override(spark, key, value))
        st.run_to_end(start, least_partitions=max(FILES, _files_for(fx.tx(spark, sf).count())))
    return spark.read.parquet(f"{base}/out")


@register("stream_tumbling", REGISTRY["tumbling_counts"][1])
def stream_tumbling(spark, sf):
    """Per-minute event counts with a watermark in update mode; the last
    update of every window equals the batch count."""
    base = _scratch(spark, "tumbling")
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", fx.ntz_as_utc("ts")).select("event_id", "ts", "event_type", "value")

    def start():
        s = st.stream_parquet(spark, f"{base}/src", ev.schema, MANY)
        t = st.tumbling_counts(s, "ts", "event_type", "value", "1 minute", "10 minutes")
        return t.writeStream.outputMode("update").foreachBatch(_foreach_append(f"{base}/out")) \
                .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()

    _replay(ev, f"{base}/src", "ts", start)
    out = spark.read.parquet(f"{base}/out")
    last = out.groupBy("window_start", "window_end", "event_type").agg(
        F.max_by(F.struct("n", "total_value"), "batch_id").alias("l"))
    return last.select("window_start", "window_end", "event_type", "l.n", "l.total_value")
