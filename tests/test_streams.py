"""Streams: restart and replay change nothing; the stream fold equals the batch."""

import uuid

from pyspark.sql import functions as F

from riskspark.operators import counters as ct
from riskspark.session import checkpoint_path
from riskspark.sources import fixtures as fx
from riskspark.sources import folders
from riskspark.sources.metric_store import write_metrics
from riskspark.streaming import streams as st
from riskspark.streaming.files import audited_stream, stream_in_name_order
from riskspark.streaming.velocity import velocity_stream
from support import SF_SMALL


def _counters_stream(spark, src, out, ckpt, schema):
    def process(batch, batch_id):
        rows = ct.batch_counters(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
                                 .withColumn("batch_ts", F.timestamp_seconds(F.lit(batch_id))))
        write_metrics(rows, out)
    s = st.stream_parquet(spark, src, schema, 1)
    return s.writeStream.foreachBatch(process).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


def test_restart_and_new_files_give_batch_totals(spark):
    base = checkpoint_path(spark, "test-streams", uuid.uuid4().hex)
    tx = fx.tx(spark, SF_SMALL)
    first, second = tx.where("unix_time % 2 = 0"), tx.where("unix_time % 2 = 1")
    first.coalesce(1).write.parquet(f"{base}/src")
    schema = spark.read.parquet(f"{base}/src").schema
    st.run_to_end(lambda: _counters_stream(spark, f"{base}/src", f"{base}/m", f"{base}/ck", schema))
    second.coalesce(1).write.mode("append").parquet(f"{base}/src")
    # restart from the same checkpoint: only the new file is read
    st.run_to_end(lambda: _counters_stream(spark, f"{base}/src", f"{base}/m", f"{base}/ck", schema))
    # run again with nothing new: nothing changes
    st.run_to_end(lambda: _counters_stream(spark, f"{base}/src", f"{base}/m", f"{base}/ck", schema))
    folded = {r.name: float(r.value) for r in ct.metric_fold(spark.read.parquet(f"{base}/m")).collect()}
    assert folded["total_txns_scored"] == tx.count()
    want = tx.agg(F.sum(F.col("amt"))).first()[0]
    assert abs(folded["total_amount_processed"] - float(want)) < 1e-6


def test_replayed_batch_overwrites_itself(spark):
    base = checkpoint_path(spark, "test-replay", uuid.uuid4().hex)
    tx = fx.tx(spark, SF_SMALL).withColumn("batch_id", F.lit(3)).withColumn("batch_ts", F.current_timestamp())
    rows = ct.batch_counters(tx)
    write_metrics(rows, base)
    write_metrics(rows, base)            # the same batch again
    folded = {r.name: float(r.value) for r in ct.metric_fold(spark.read.parquet(base)).collect()}
    assert folded["total_txns_scored"] == tx.count()


def test_scoring_waits_for_a_model(spark):
    base = checkpoint_path(spark, "test-wait", uuid.uuid4().hex)
    fx.tx(spark, SF_SMALL).limit(10).write.parquet(f"{base}/src")
    schema = spark.read.parquet(f"{base}/src").schema
    q = st.score_stream(spark, f"{base}/src", schema, f"{base}/models", f"{base}/out", f"{base}/m", f"{base}/ck",
                        available_now=True)
    assert q is None


def _velocity_files(spark, path, rows, files, schema):
    """Each list of rows as one file, in order of delivery."""
    for part in files:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_velocity_with_late_rows_and_restart(spark):
    """Arrival shuffled within the watermark, one hot card, ties, null keys and amounts; stopped and started again
    between files.  The stream gives the batch's figures, each row once; rows behind the watermark are left out."""
    import random
    from decimal import Decimal
    from riskspark.functions import features as ft
    rng = random.Random(3)
    base = checkpoint_path(spark, "test-velocity", uuid.uuid4().hex)
    rows, t = [], 1_600_000_000
    for i in range(900):
        t += rng.choice([0, 1, 30, 400, 1800])
        card = 1 if rng.random() < 0.4 else rng.choice([None, *range(2, 12)])
        rows.append((i, card, t, None if i % 50 == 7 else round(rng.uniform(1, 900), 2), "é\"x"))
    arrival = sorted(range(900), key=lambda i: rows[i][2] + rng.uniform(0, 3000))
    end = len(rows)
    rows.append((-1, 99, t + 10 ** 6, 1.0, "end"))        # moves the watermark past all others
    rows.append((-2, 1, 1_500_000_000, 1.0, "too late"))  # far behind it
    rows.append((-3, 99, t + 3 * 10 ** 6, 1.0, "end"))
    schema = "trans_key long, cc_num long, unix_time long, amt double, note string"
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"

    def start():
        s = st.stream_parquet(spark, src, spark.createDataFrame([], schema).schema, 1)
        return st.sink_stage(velocity_stream(s), out, ck, available_now=True)

    for k, files in enumerate([[arrival[:150], arrival[150:300]], [arrival[300:600]], [arrival[600:], [end]], [[end + 1], [end + 2]]]):
        _velocity_files(spark, src, rows, files, schema)
        st.run_to_end(start)  # the same checkpoint: state and timers go on
    batch = ft.velocity(spark.createDataFrame(rows[:900], schema))
    key = lambda r: r.trans_key
    got = sorted((r for r in spark.read.parquet(out).collect() if r.trans_key >= 0), key=key)
    assert [r.asDict() for r in got] == [r.asDict() for r in sorted(batch.collect(), key=key)]
    assert "too late" not in {r.note for r in spark.read.parquet(out).collect()}


def test_named_files_arrive_in_name_order_each_once(spark):
    """Files written in reverse time order; new files and restarts between the micro-batches."""
    base = checkpoint_path(spark, "test-names", uuid.uuid4().hex)
    def write(i):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{base}/one-{i}")
        folders.move_file(spark, f"{base}/one-{i}", ".parquet", f"{base}/src", f"f{i:03d}.parquet")
    seen = {}
    def start():
        s = stream_in_name_order(spark, f"{base}/src", spark.range(1).schema, max_files=2)
        return (s.writeStream.foreachBatch(lambda d, b: seen.setdefault(b, []).extend(r.id for r in d.collect()))
                .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    for new in ([5, 4, 3, 2, 1], [], [8, 7], [], []):
        for i in new:
            write(i)
        st.run_to_end(start)
    assert [sorted(v) for _, v in sorted(seen.items()) if v] == [
        [*range(10, 30)], [*range(30, 50)], [*range(50, 60), *range(70, 80)], [*range(80, 90)]]


def test_stream_over_sound_torn_and_half_damaged_files(spark):
    """Good files arrive whole, the others stand in the ledger once, also after a restart."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    base = checkpoint_path(spark, "test-audit", uuid.uuid4().hex)
    import os
    os.makedirs(f"{base}/src")
    for i in range(6):  # three row groups a file
        pq.write_table(pa.table({"id": range(i * 3000, (i + 1) * 3000), "v": [float(x % 97) for x in range(3000)]}), f"{base}/src/{i}.parquet",
                       row_group_size=1000, compression="none", use_dictionary=False)
    with open(f"{base}/src/1.parquet", "r+b") as f:
        f.truncate(20_000)                             # torn: no footer
    with open(f"{base}/src/4.parquet", "r+b") as f:    # the second row group is damaged, the footer sound
        at = pq.ParquetFile(f"{base}/src/4.parquet").metadata.row_group(1).column(0).data_page_offset
        f.seek(at)
        f.write(b"\xff" * 64)
    open(f"{base}/src/5.parquet", "wb").write(b"no parquet at all")
    schema = spark.read.parquet(f"{base}/src/0.parquet").schema

    def append(d, b):
        d.write.mode("overwrite").parquet(f"{base}/out/batch_id={b}")

    for _ in range(2):
        st.run_to_end(lambda: audited_stream(spark, f"{base}/src", schema, append, f"{base}/ledger", f"{base}/ck", max_files=2, available_now=True))
    got = sorted(r.id for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [x for i in (0, 2, 3) for x in range(i * 3000, (i + 1) * 3000)]
    assert sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(f"{base}/ledger").collect()) == ["1.parquet", "4.parquet", "5.parquet"]


def test_smoothing_stream_replays_a_batch(spark):
    """State is taken from the batch before, so a batch that is run again gives the same rows; old states go."""
    from riskspark.operators import smoothing
    base = checkpoint_path(spark, "test-smooth", uuid.uuid4().hex)
    rows = [(k, i, float((i * 7919 + len(k)) % 120_000)) for k in ("a", "bb") for i in range(90)] + [("old", 0, 5.0)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    def start():
        s = st.stream_parquet(spark, f"{base}/src", df.schema, 100)
        return st.smooth_stream(s, ["k"], ["t"], "x", f"{base}/out", f"{base}/state", f"{base}/ck", available_now=True)
    for lo in range(0, 90, 30):
        df.where(F.col("t").between(lo, lo + 29)).write.mode("append").parquet(f"{base}/src")
        st.run_to_end(start)
    want = {(r.k, r.t): r.ema for r in smoothing.ema(df, ["k"], ["t"], "x").collect()}
    out = lambda: {(r.k, r.t): r.ema for r in spark.read.parquet(f"{base}/out").collect()}
    assert out() == want and folders.numbers(spark, f"{base}/state", "batch_id") == [1, 2]
    folders.remove(spark, f"{base}/ck/commits/2")  # as if the last batch had not been committed
    st.run_to_end(start)
    assert out() == want
    assert {r.k for r in spark.read.parquet(f"{base}/state/batch_id=2").collect()} == {"a", "bb", "old"}


def test_velocity_step_needs_no_package_on_the_workers(tmp_path):
    """A worker that has only pyspark, numpy, pandas and pyarrow can load the step."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from riskspark.streaming.velocity import velocity_step
    (tmp_path / "step").write_bytes(cloudpickle.dumps(velocity_step(3600)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import pickle; pickle.load(open('step', 'rb')); import sys; assert not [m for m in sys.modules if m.startswith('riskspark')]"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_large_deliveries_come_in_more_files(spark, monkeypatch):
    from riskspark.plans import catalog
    catalog.queries()
    from riskspark.plans import q_streams
    monkeypatch.setattr(fx, "ROWS_PER_FILE", 100)
    path = checkpoint_path(spark, "test-deliver", uuid.uuid4().hex)
    each = q_streams._deliver(spark.range(1200), path)
    assert each == 3
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 12 and max(r["count"] for r in files) <= 150 and sum(r["count"] for r in files) == 1200


def test_audited_files_stay_small(spark, monkeypatch, tmp_path):
    from riskspark.plans import catalog
    catalog.queries()
    from riskspark.plans import q_streams
    monkeypatch.setattr(fx, "ROWS_PER_FILE", 100)
    spark.range(2100).selectExpr("id as l_orderkey", "cast(id % 7 + 1 as int) as l_linenumber", "cast(id as double) as l_quantity").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    sizes, move = [], folders.move_files

    def watched(spark, folder, *args, **more):
        sizes.extend(r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect())
        move(spark, folder, *args, **more)

    monkeypatch.setattr(folders, "move_files", watched)
    out = q_streams.stream_audited(spark, str(tmp_path)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("t")).collect()
    assert {r["kind"]: (r["n"], r["t"]) for r in out} == {"row": (1800, 1), "broken file": (1, 1)}
    assert len(sizes) == 21 and max(sizes) <= 150
