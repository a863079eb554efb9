"""Telemetry parser follows the line rules (tag, last key wins, bad number voids the line)."""

from riskspark.functions import text as tx


def _parse(spark, lines):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "line_no long, line string")
    return {r.line_no: r for r in tx.parse_telemetry(df, keep=["line_no"]).collect()}


def test_sample_line(spark):
    line = ("[TELEMETRY] stage=Merge | status=Idle | rows=4711 | throughput=812 | elapsed=5.8 | "
            "cpu_cores=2.5 | ram_gb=3.25 | ram_percent=41.5")
    r = _parse(spark, [line])[0]
    assert (r.stage, r.status, r.rows, r.throughput, r.elapsed, r.cpu_cores, r.ram_gb, r.ram_percent) == \
        ("Merge", "Idle", 4711, 812, 5.8, 2.5, 3.25, 41.5)
    assert r.fraud_blocked is None


def test_rules(spark):
    got = _parse(spark, [
        "no tag | rows=5",                                          # dropped: no tag
        "[TELEMETRY] stage=A | rows=12x",                            # dropped: bad integer
        "[TELEMETRY] stage=A | rows=1 | rows=2 |  elapsed = 3.5 ",   # last key wins, spaces trimmed
        "[TELEMETRY] stage=B | rows=5.0",                            # int('5.0') fails in the reference
        "[TELEMETRY] stage=C | note=a=b | rows=7",                   # value keeps later '='
    ])
    assert set(got) == {2, 4}
    assert (got[2].rows, got[2].elapsed) == (2, 3.5)
    assert got[4].rows == 7


def test_usage_and_quantities(spark):
    df = spark.createDataFrame([("web-7d9f-x2k4   250m  300Mi",), ("solo 2 10",), ("bad",)], "line string")
    rows = sorted(tx.parse_usage(df).collect())
    assert [(r.pod, r.app, r.cpu_millicores, r.mem_mib) for r in rows] == [
        ("solo", "solo", 2, 10), ("web-7d9f-x2k4", "web", 250, 300)]
    q = spark.createDataFrame([("8", "2Gi"), ("8000m", "1024"), ("x", "3Pi")], "cpu string, mem string")
    from pyspark.sql import functions as F
    got = q.select(tx.cpu_millicores(F.col("cpu")).alias("c"), tx.memory_bytes(F.col("mem")).alias("m")).collect()
    assert [(r.c, r.m) for r in got] == [(8000, 2 * 1024 ** 3), (8000, 1024 * 1024), (None, None)]
