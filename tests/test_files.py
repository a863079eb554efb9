"""File sources: listing, sizes below a folder, unreadable files, retention per topic; model version per batch."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.operators import telemetry
from riskspark.sources import readers as rd
from riskspark.streaming import streams as st


@pytest.fixture
def runs(spark, tmp_path):
    root = tmp_path / "a b+c%"
    for topic, run, n in (("raw", "run_1", 3), ("raw", "run_2", 5), ("feat", "run_1", 0)):
        spark.range(n).coalesce(1).write.parquet(str(root / topic / run))
    return root


def test_listing_and_sizes(spark, runs):
    got = {(r.topic, r.run): (r.rows, r.bytes) for r in rd.list_files(spark, str(runs)).collect()}
    assert {k: v[0] for k, v in got.items()} == {("raw", "run_1"): 3, ("raw", "run_2"): 5, ("feat", "run_1"): 0}
    size = {p: sum(f.stat().st_size for f in (runs / p).rglob("*") if f.is_file() and not f.name.startswith((".", "_"))) for p in ("raw", "feat")}
    assert {r.directory: r.bytes for r in rd.storage_bytes(spark, str(runs)).collect()} == size
    assert {r.directory: r.files for r in rd.storage_bytes(spark, str(runs), depth=2).collect()} == {
        "raw/run_1": 1, "raw/run_2": 1, "feat/run_1": 1}


def test_unreadable_files_are_reported(spark, runs):
    good = next((runs / "raw" / "run_1").glob("*.parquet"))
    (runs / "raw" / "run_2" / "torn.parquet").write_bytes(good.read_bytes()[:-20])
    (runs / "raw" / "run_2" / "text.parquet").write_text("no parquet at all")
    (runs / "raw" / "run_2" / "none.parquet").write_bytes(b"")
    rows, bad = rd.read_or_quarantine(spark, str(runs), T.StructType([T.StructField("id", T.LongType())]))
    assert rows.count() == 8
    named = {r.path.rsplit("/", 1)[1] for r in bad.collect() if "feat" not in r.path}
    assert named == {"torn.parquet", "text.parquet"}  # and the file without rows, but not the one without bytes


def test_files_damaged_after_the_first_rows_are_quarantined(spark, tmp_path):
    def write(name, damaged):
        table = pa.table({"id": list(range(30_000)), "note": [f"{name} {i}" for i in range(30_000)], "tags": [[i] for i in range(30_000)]})
        pq.write_table(table, tmp_path / name, row_group_size=10_000, use_dictionary=False)
        if damaged is not None:
            group, column = damaged
            chunk = pq.ParquetFile(tmp_path / name).metadata.row_group(group).column(column)
            raw = bytearray((tmp_path / name).read_bytes())
            raw[chunk.data_page_offset:chunk.data_page_offset + chunk.total_compressed_size] = b"\xff" * chunk.total_compressed_size
            (tmp_path / name).write_bytes(raw)

    for name, damaged in (("sound.parquet", None), ("later.parquet", (1, 1)), ("first.parquet", (0, 0)), ("nested.parquet", (2, 2))):
        write(name, damaged)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType()),
                           T.StructField("tags", T.ArrayType(T.LongType()))])
    rows, bad = rd.read_or_quarantine(spark, str(tmp_path), schema)
    assert rows.columns == schema.names
    assert {r.kind: r["count"] for r in rows.groupBy(F.split("note", " ")[0].alias("kind")).count().collect()} == {"sound.parquet": 30_000}
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {"later.parquet", "first.parquet", "nested.parquet"}
    rows, bad = rd.read_or_quarantine(spark, str(tmp_path), T.StructType(schema.fields[:1]))  # what is not read is not judged
    assert rows.count() == 90_000 and [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["first.parquet"]


def test_retention_by_topic(spark):
    now = dt.datetime(2024, 5, 2, 12)
    rows = [(t, now - dt.timedelta(hours=h) if h is not None else None) for t in ("a", "b", "c") for h in (1, 7, 30, None)]
    df = spark.createDataFrame(rows, "topic string, mtime timestamp_ntz")
    limits = spark.createDataFrame([("a", 6), ("b", 24)], "topic string, hours int")
    kept = rd.retention_by_topic(df, limits, F.lit(now).cast("timestamp_ntz"), "mtime")
    assert {r.topic: r["count"] for r in kept.groupBy("topic").count().collect()} == {"a": 1, "b": 2, "c": 3}


def test_model_version_of_a_batch_is_kept(spark, tmp_path):
    results = str(tmp_path / "results")
    assert st._pinned_version(spark, results, 4) is None
    spark.createDataFrame([(7,)], "version int").write.parquet(st._pin_path(results, 4))
    assert st._pinned_version(spark, results, 4) == 7 and st._pinned_version(spark, results, 5) is None


def test_previous_stage_needs_a_near_line(spark):
    line = lambda stage, n: f"{telemetry.TAG} stage={stage} | rows={n}"
    rows = [("l", 1, line("Data Prep", 5), "Data Prep", 5), ("l", 50, "plain", None, None), ("l", 90, line("Data", 2), "Data", 2),
            ("l", 91, line("Model", 3), "Model", 3), ("l", 300, line("Data", 9), "Data", 9)]
    d = spark.createDataFrame(rows, "log string, line_no long, line string, stage string, rows long")
    got = {r.line_no: r.previous_total for r in telemetry.previous_stage_rows(d).collect()}
    assert got == {1: 0, 90: 0, 91: 2, 300: 0}  # a stage whose name starts the earlier one counts as the same
