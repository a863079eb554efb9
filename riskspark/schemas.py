"""Fixed schemas of the data the library reads and writes (FIXTURES.md §1)."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("unix_time", T.LongType()),
    T.StructField("cc_num", T.LongType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("amt", T.FloatType()),
    T.StructField("first", T.StringType()),
    T.StructField("last", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("street", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("zip", T.IntegerType()),
    T.StructField("lat", T.FloatType()),
    T.StructField("long", T.FloatType()),
    T.StructField("city_pop", T.IntegerType()),
    T.StructField("job", T.StringType()),
    T.StructField("dob", T.StringType()),
    T.StructField("trans_num", T.StringType()),
    T.StructField("merch_lat", T.FloatType()),
    T.StructField("merch_long", T.FloatType()),
    T.StructField("is_fraud", T.ByteType()),
    T.StructField("merch_zipcode", T.IntegerType()),
])

# The transaction stand-in used by tests (money as decimal, ``lon`` for ``long``).
TX = T.StructType([
    T.StructField("trans_key", T.LongType()),
    T.StructField("unix_time", T.LongType()),
    T.StructField("cc_num", T.LongType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("amt", T.DecimalType(18, 2)),
    T.StructField("state", T.StringType()),
    T.StructField("zip", T.IntegerType()),
    T.StructField("is_fraud", T.IntegerType()),
    T.StructField("fraud_score", T.DoubleType()),
])

METRICS = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.DecimalType(38, 6)),
    T.StructField("ts", T.TimestampType()),
])

SAMPLES = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])

TELEMETRY = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("throughput", T.LongType()),
    T.StructField("fraud_blocked", T.LongType()),
    T.StructField("elapsed", T.DoubleType()),
    T.StructField("cpu_cores", T.DoubleType()),
    T.StructField("ram_gb", T.DoubleType()),
    T.StructField("ram_percent", T.DoubleType()),
])

FILES = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("run", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
])
