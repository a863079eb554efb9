"""The metric store as a table.

Counters and gauges are rows ``(batch_id, name, kind, value, ts)``.  A batch
writes its rows once, keyed by ``batch_id``; replaying a batch rewrites the
same rows (see ``metric_store.write_metrics``), so nothing is counted twice.  The
current value of a name is a fold: counters add up, gauges take the newest
value.  Values are DECIMAL so that folds do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import BAND_CUTS, FRAUD_THRESHOLD, risk_band

VALUE = "decimal(38,6)"


def _rows(batch: str, ts: Column, name: Column, kind: str, value: Column) -> Column:
    return F.struct(F.col(batch).cast("bigint").alias("batch_id"), name.alias("name"), F.lit(kind).alias("kind"),
                    value.cast(VALUE).alias("value"), ts.alias("ts"))


def batch_counters(scored: DataFrame, batch: str = "batch_id", ts: str = "batch_ts",
                   threshold: float = FRAUD_THRESHOLD) -> DataFrame:
    """The scorer's counters for each batch, as metric rows.

    totals, flagged totals, band counts, and per category / state counts and
    amounts of flagged rows; the category mean score is kept as a sum and a
    count (a mean of means would be wrong across batches).  One aggregate per (batch,
    category) gives those rows and, added up, the batch's totals; another reads only
    flagged rows per (batch, state).
    """
    f = F.col("fraud_score") >= threshold
    amt = F.col("amt").cast("decimal(18,2)")
    band = risk_band("fraud_score", BAND_CUTS)
    d = (scored.withColumn("category", F.coalesce("category", F.lit("unknown")))
               .withColumn("state", F.coalesce("state", F.lit("unknown"))))
    sums = ["n", "amount", "flagged", "flagged_amount", "score_sum", "band_low", "band_medium", "band_high"]
    flagged = [F.count(F.when(f, 1)).alias("flagged"), F.coalesce(F.sum(F.when(f, amt)), F.lit(0)).alias("flagged_amount")]
    per_category = d.groupBy(batch, "category").agg(
        F.max(ts).alias("_ts"), F.count(F.lit(1)).alias("n"), F.sum(amt).alias("amount"), *flagged,
        F.sum(F.when(f, F.col("fraud_score").cast("decimal(12,4)"))).alias("score_sum"),
        *[F.count(F.when(band == b, 1)).alias(f"band_{b}") for b in ("low", "medium", "high")])
    g = per_category.groupingSets([[batch], [batch, "category"]], batch, "category").agg(
        F.grouping_id().alias("_gid"), F.max("_ts").alias("_ts"), *[F.sum(c).alias(c) for c in sums])
    per_state = d.where(f).groupBy(batch, "state").agg(F.max(ts).alias("_ts"), *flagged)
    t = F.col("_ts")
    totals = [
        _rows(batch, t, F.lit("total_txns_scored"), "counter", F.col("n")),
        _rows(batch, t, F.lit("total_amount_processed"), "counter", F.col("amount")),
        _rows(batch, t, F.lit("fraud_blocked_count"), "counter", F.col("flagged")),
        _rows(batch, t, F.lit("total_fraud_amount_identified"), "counter", F.col("flagged_amount")),
        *[_rows(batch, t, F.lit(f"fraud_dist_{b}"), "counter", F.col(f"band_{b}")) for b in ("low", "medium", "high")],
        _rows(batch, t, F.lit("last_batch_size"), "gauge", F.col("n")),
    ]
    pre = F.concat(F.lit("category_"), F.col("category"))
    cats = [
        _rows(batch, t, F.concat(pre, F.lit("_count")), "counter", F.col("flagged")),
        _rows(batch, t, F.concat(pre, F.lit("_amount")), "counter", F.col("flagged_amount")),
        _rows(batch, t, F.concat(pre, F.lit("_score_sum")), "counter", F.col("score_sum")),
    ]
    spre = F.concat(F.lit("state_"), F.col("state"))
    states = [
        _rows(batch, t, F.concat(spre, F.lit("_count")), "counter", F.col("flagged")),
        _rows(batch, t, F.concat(spre, F.lit("_amount")), "counter", F.col("flagged_amount")),
    ]
    # grouping_id: 1 = the whole batch, 0 = (batch, category)
    rows = F.when(F.col("_gid") == 1, F.array(*totals)).when(F.col("flagged") > 0, F.array(*cats))
    return (g.select(F.explode(rows).alias("m")).unionByName(per_state.select(F.explode(F.array(*states)).alias("m")))
            .select("m.*"))


def metric_increment(df: DataFrame, batch_id: int, name: str, value: Column | None = None,
                     ts: Column | None = None) -> DataFrame:
    """One counter row for a batch: ``value`` aggregated over ``df``
    (default: its row count).  Written with ``metric_store.write_metrics``, a replay
    of the same batch id replaces the row instead of adding it again."""
    v = value if value is not None else F.count(F.lit(1))
    return df.agg(v.cast(VALUE).alias("value")).select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(name).alias("name"), F.lit("counter").alias("kind"),
        "value", (ts if ts is not None else F.current_timestamp()).alias("ts"))


def metric_set(df: DataFrame, batch_id: int, name: str, value: Column, ts: Column | None = None) -> DataFrame:
    """One gauge row for a batch (the newest gauge row wins in the fold)."""
    return df.agg(value.cast(VALUE).alias("value")).select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(name).alias("name"), F.lit("gauge").alias("kind"),
        "value", (ts if ts is not None else F.current_timestamp()).alias("ts"))


def metric_fold(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """Current value per name: counters summed, gauges the newest value
    (by ts, then batch_id).  ``prefix`` keeps names that start with it."""
    m = metrics.where(F.col("name").startswith(prefix)) if prefix else metrics
    order = F.struct("ts", "batch_id")
    n = F.sum("n") if "n" in metrics.columns else F.count(F.lit(1))  # a compacted row stands for several
    return m.groupBy("name", "kind").agg(
        F.when(F.col("kind") == "counter", F.sum("value")).otherwise(F.max_by("value", order)).alias("value"),
        n.cast("bigint").alias("n_batches"))


def category_avg_score(folded: DataFrame) -> DataFrame:
    """Mean flagged score per category from the folded ``_score_sum`` and ``_count``."""
    c = folded.where(F.col("name").rlike("^category_.*_(score_sum|count)$"))
    cat = F.regexp_extract("name", "^category_(.*)_(score_sum|count)$", 1)
    part = F.regexp_extract("name", "^category_(.*)_(score_sum|count)$", 2)
    g = c.groupBy(cat.alias("category")).agg(
        F.sum(F.when(part == "score_sum", F.col("value"))).alias("s"),
        F.sum(F.when(part == "count", F.col("value"))).alias("n"))
    return g.select("category", (F.col("s").cast("double") / F.col("n").cast("double")).alias("avg_score"))


# Exposition names, help texts, types and the store metric each one reads.
EXPOSITION = [
    ("fraud_det_transactions_total", "Total transactions analyzed", "counter", "total_txns_scored"),
    ("fraud_det_high_risk_total", "Total high-risk transactions flagged", "counter", "fraud_blocked_count"),
    ("fraud_det_fraud_exposure_usd", "Total potential fraud identified in USD", "gauge", "total_fraud_amount_identified"),
    ("fraud_det_throughput_tps", "Current pipeline throughput in txns/sec", "gauge", "throughput"),
    ("fraud_det_decision_latency_ms", "Model decision latency in milliseconds", "gauge", "decision_latency_ms"),
]
# Names of our own: the volumes are not named after a product.
EXPOSITION += [
    ("fraud_det_cpu_volume_throughput_mbps", "CPU volume throughput", "gauge", "cpu_volume_throughput"),
    ("fraud_det_gpu_volume_throughput_mbps", "GPU volume throughput", "gauge", "gpu_volume_throughput"),
]


def exposition_lines(folded: DataFrame) -> DataFrame:
    """The text exposition of the seven dashboard metrics:
    ``# HELP``, ``# TYPE`` and ``name value`` lines in a fixed order (a metric
    missing from the store reads 0).  Output (pos, line)."""
    spark = folded.sparkSession
    spec = spark.createDataFrame([(i, *e) for i, e in enumerate(EXPOSITION)],
                                 "idx int, name string, help string, type string, source string")
    wanted = folded.where(F.col("name").isin([e[3] for e in EXPOSITION]))  # at most 7 names per kind
    j = spec.join(wanted.select(F.col("name").alias("source"), "value"), "source", "left")
    val = F.coalesce(F.col("value"), F.lit(0).cast(VALUE))
    text = F.when(val == F.floor(val), F.floor(val).cast("bigint").cast("string")).otherwise(
        F.regexp_replace(val.cast("decimal(38,6)").cast("string"), "0+$", ""))
    lines = F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("# HELP "), "name", F.lit(" "), "help").alias("line")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "type").alias("line")),
        F.struct(F.lit(2).alias("k"), F.concat("name", F.lit(" "), text).alias("line")))
    return j.select("idx", F.explode(lines).alias("l")).select(
        (F.col("idx") * 3 + F.col("l.k")).cast("int").alias("pos"), F.col("l.line").alias("line"))
