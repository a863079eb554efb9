"""Streams hold no more copies of their rows than they say."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.plans import catalog
from riskspark.session import checkpoint_path
from riskspark.sources import fixtures as fx
from riskspark.sources.sinks import dual_sink
from riskspark.streaming import streams as st
from support import SF_SMALL


def _no(*_args, **_more):
    raise AssertionError("a copy of the rows is made")


def test_dual_sink_keeps_no_third_copy(spark, monkeypatch):
    base = checkpoint_path(spark, "test-dual", uuid.uuid4().hex)
    a, b = f"{base}/a", f"{base}/b"
    rows = lambda p: sorted(map(tuple, spark.read.parquet(p).collect()))
    monkeypatch.setattr(DataFrame, "persist", _no)
    d = spark.range(100).withColumn("r", F.rand())  # computed twice it would differ
    dual_sink(d, a, b, 3)
    dual_sink(spark.range(5).withColumn("r", F.lit(0.5)), a, b, 4)
    assert len(rows(a)) == 105 and rows(a) == rows(b)
    dual_sink(d, a, b, 3)  # a replay replaces both
    assert len(rows(a)) == 105 and rows(a) == rows(b)
    dual_sink(d.limit(0), a, b, 5)
    assert rows(a) == rows(b) and {r.batch_id for r in spark.read.parquet(b).collect()} == {3, 4}


def test_streams_read_the_stored_transactions(spark, monkeypatch):
    catalog.queries()
    from riskspark.plans import q_streams
    monkeypatch.setattr(q_streams, "_deliver", _no)
    n = fx.tx(spark, SF_SMALL).count()
    for query in ("stream_features", "dual_sink", "stream_dedupe"):
        assert catalog.queries()[query](spark, SF_SMALL).count() == n


def test_few_stored_files_are_delivered_anew(spark, monkeypatch):
    catalog.queries()
    from riskspark.plans import q_streams
    monkeypatch.setattr(q_streams, "FILES", 10_000)
    seen = []
    monkeypatch.setattr(q_streams, "_deliver", lambda df, path: seen.append(df.count()) or 1)
    n = fx.tx(spark, SF_SMALL).count()
    assert q_streams._raw(spark, SF_SMALL, "x") == ("x/raw", 1) and q_streams._replayed(spark, SF_SMALL, "x") == ("x/src", 1)
    assert seen == [n, fx.tx_replayed(spark, SF_SMALL).count()]


def test_unlike_rows_have_unlike_digests(spark):
    rows = [(None, "a", "", 1.0, 0), ("a", None, "", 1.0, 0), ("a", "", None, 1.0, 0), ("", "a", "-", 1.0, 0), ("1:a", "", "", 1.0, 0),
            ("a", "b", "", 1.0, 0), ("ab", "", "", 1.0, 0), ("ab", "", "", 1.0000000000000002, 0), ("ab", "", "", None, 0), ("ab", "", "", 1.0, None)]
    d = spark.createDataFrame(rows * 2, "a string, b string, c string, d double, e int")
    assert d.select(st.row_digest(d, d.columns).alias("k")).distinct().count() == len(rows)
    assert st.row_digest(d, ["a", "b"]) is None
    nested = d.withColumn("f", F.array("a"))
    assert st.row_digest(nested, nested.columns) is None


def test_instants_of_one_local_time_differ(spark):
    from riskspark.session import conf_override
    with conf_override(spark, "spark.sql.session.timeZone", "Europe/Berlin"):
        d = spark.range(2).selectExpr("timestamp_seconds(1698539400 + id * 3600) as t", "1 as a", "2 as b", "3 as c", "4 as d")
        assert d.select(F.col("t").cast("string")).distinct().count() == 1
        assert d.select(st.row_digest(d, d.columns)).distinct().count() == 2
