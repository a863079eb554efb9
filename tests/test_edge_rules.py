"""Rules at the edges: counter windows, null keys, stream ends, registry, parser, shared folders."""

import datetime as dt
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskspark import session
from riskspark.functions import text
from riskspark.operators import ml, samples as sm, series, windows
from riskspark.sources import readers as rd
from riskspark.streaming import streams as st


@pytest.mark.parametrize("poll", [15, 60])
def test_counter_rate_loses_nothing_between_windows(spark, poll):
    """A counter that grows by 1 a second has rate 1.0 at any poll interval, across a reset and a gap."""
    t0 = dt.datetime(2024, 1, 1)
    ticks = [s for s in range(0, 1800, poll) if not 600 < s < 900]
    rows = [("c", {"cpu": "0"}, t0 + dt.timedelta(seconds=s), float(s)) for s in ticks]
    s = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double")
    got = sm.counter_rate(s, 60).orderBy("window_start").collect()
    assert got[0].rate is None if poll == 60 else got[0].rate == 1.0
    assert {r.rate for r in got[1:]} == {1.0}
    assert sum(r.increase for r in got) == ticks[-1]
    reset = spark.createDataFrame([("c", {"cpu": "0"}, t0 + dt.timedelta(seconds=x), v) for x, v in ((0, 50.0), (30, 80.0), (60, 30.0))], s.schema)
    assert [r.increase for r in sm.counter_increase(reset, 60).orderBy("window_start").collect()] == [30.0, 30.0]


def test_null_key_is_a_key(spark):
    rows = [(None, i, float(i), "mine") for i in range(6)] + [("k", i, 1.0, "mine") for i in range(3)]
    d = spark.createDataFrame(rows, "k string, t long, v double, prev_note string")
    prev = windows.previous_row(d, ["k"], ["t"], ["v"], F.floor(F.col("t") / 2)).orderBy("t").collect()
    assert [r.prev_v for r in prev if r.k is None] == [None, 0.0, 1.0, 2.0, 3.0, 4.0]
    assert {r.prev_note for r in prev} == {"mine"}
    run = series.cumulative(d, ["k"], ["t"], "v", "sum", bucket=F.floor(F.col("t") / 2)).orderBy("t").collect()
    assert [r.running_sum for r in run if r.k is None] == [0.0, 1.0, 3.0, 6.0, 10.0, 15.0]


def test_stream_that_does_not_end_raises(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))

    def slow(batch, number):
        import time
        time.sleep(20)

    def start():
        s = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        return s.writeStream.foreachBatch(slow).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    with pytest.raises(TimeoutError):
        st.run_to_end(start, timeout_s=2)
    assert not spark.streams.active


def test_stream_dedupe_keeps_late_first_copies(spark, tmp_path):
    for i, day in enumerate((300, 1, 150)):  # event times far apart and out of order
        spark.range(100).selectExpr(f"id + {i * 100} as id", f"timestamp_seconds({day} * 86400 + id) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.range(50).selectExpr("id", "timestamp_seconds(300 * 86400 + id) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def start():
        s = st.stream_parquet(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
        return st.sink_stage(st.dedupe_stream(s, "1 day"), str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)

    st.run_to_end(start)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300


def test_dedupe_batches_holds_few_rows_in_a_task(spark, monkeypatch, capsys):
    """No rows are held before the shuffle, and a task after it gets a bounded number of them."""
    monkeypatch.setattr(rd, "DEDUPE_ROWS", 50)
    odd = [(None, None, None), (None, "", None), (0, "a", 0.0), (0, "a", -0.0), (0, "a", float("nan")), (0, "a", float("nan"))]
    rows = [(i % 1000, f"s{i % 1000}", i % 1000 / 4) for i in range(1100)] + odd * 3
    d = spark.createDataFrame(rows, "`k.1` long, `s``` string, v double")
    got = rd.dedupe_batches(d)
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.partition("Exchange")[2]
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) <= 100
    assert got.count() == 1004 and sorted(map(str, got.collect())) == sorted(map(str, d.dropDuplicates().collect()))
    assert rd.dedupe_batches(d, rows=1).count() == 1004 and rd.dedupe_batches(d.limit(0)).count() == 0
    same_names = d.selectExpr("v as x", "`k.1` as X")
    assert rd.dedupe_batches(same_names).count() == same_names.dropDuplicates().count()
    assert rd.dedupe_batches(d, ["s`"]).count() == 1003


def test_unreadable_registry_is_an_error(spark, tmp_path):
    assert ml.registry_table(spark, str(tmp_path / "none")) is None and ml.next_version(spark, str(tmp_path / "none")) == 1
    os.makedirs(tmp_path / "bad/_registry")
    (tmp_path / "bad/_registry/part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception) as e:
        ml.next_version(spark, str(tmp_path / "bad"))
    assert not (isinstance(e.value, AnalysisException) and e.value.getCondition() == "PATH_NOT_FOUND")


def test_parser_edges(spark):
    lines = ["[TELEMETRY] stage=Ingest\t|\trows=5 | elapsed = 1.5 |x=1|x=2", "[TELEMETRY] stage=Ingest | rows=5 | elapsed=5d",
             "[TELEMETRY] stage=Ingest | rows=5 | cpu_cores=1.5f"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    good = text.parse_telemetry(d, keep=["n"], with_extra=True).collect()
    assert [(r.n, r.stage, r.rows, r.elapsed, r.extra) for r in good] == [(0, "Ingest", 5, 1.5, {"x": "2"})]
    assert {r.n for r in text.bad_telemetry(d, keep=["n"]).collect()} == {1, 2}


def test_missing_shared_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
