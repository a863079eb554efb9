"""Risk aggregates and business measures over scored transactions.

Input: a scored frame with ``fraud_score`` (double in [0, 1]), ``amt``
(money, decimal), ``category``, ``state``, ``unix_time``, ``trans_key`` and the
alert fields.  Money is summed as DECIMAL and cast to DOUBLE once at the end,
so that the result does not depend on the order rows are added in; averages
are exact sums divided by counts.

All measures are hash aggregates with map-side partial aggregation; the only
ordered operations run on aggregated rows (a few hundred at most) or use
order + limit for a small, fixed n.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import BAND_CUTS, FRAUD_THRESHOLD, mask_card, risk_band, seconds_ago
from ..session import checkpoint_path
from .selection import kth_cut, below_cut
from .sketch import sketch_quantiles

SCORE = "fraud_score"
MONEY = "decimal(18,2)"


def money_sum(c: str | Column, cond: Column | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    col = col.cast(MONEY)
    if cond is not None:
        col = F.when(cond, col)
    return F.coalesce(F.sum(col), F.lit(0).cast(MONEY)).cast("double")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1))).cast("bigint")


def flagged(threshold: float = FRAUD_THRESHOLD) -> Column:
    return F.col(SCORE) >= F.lit(threshold)


def high_risk(df: DataFrame, threshold: float = FRAUD_THRESHOLD) -> DataFrame:
    """flagged rows; a null category or state becomes 'unknown'."""
    return (df.where(flagged(threshold))
              .withColumn("category", F.coalesce(F.col("category"), F.lit("unknown")))
              .withColumn("state", F.coalesce(F.col("state"), F.lit("unknown"))))


def _flag_measures() -> list[Column]:
    return [F.count(F.lit(1)).cast("bigint").alias("flagged_count"),
            money_sum("amt").alias("flagged_amount")]


def category_risk(df: DataFrame, threshold: float = FRAUD_THRESHOLD) -> DataFrame:
    """A4: count, amount and mean score of flagged rows per category."""
    return (high_risk(df, threshold).groupBy("category")
            .agg(*_flag_measures(),
                 (F.sum(F.col(SCORE).cast("decimal(12,4)")).cast("double")
                  / F.count(F.lit(1)).cast("double")).alias("avg_score")))


def state_risk(df: DataFrame, threshold: float = FRAUD_THRESHOLD) -> DataFrame:
    """A5: count and amount of flagged rows per state."""
    return high_risk(df, threshold).groupBy("state").agg(*_flag_measures())


def risk_rollup(df: DataFrame, threshold: float = FRAUD_THRESHOLD, cube: bool = False) -> DataFrame:
    """Category x state with subtotals and a grand total in one aggregate
    (``rollup``, or ``cube`` for every subtotal); ``gid`` tells the level."""
    g = high_risk(df, threshold)
    g = g.cube("category", "state") if cube else g.rollup("category", "state")
    return g.agg(F.grouping_id().cast("int").alias("gid"), *_flag_measures())


def risk_distribution(df: DataFrame, cuts=BAND_CUTS) -> DataFrame:
    """A1: rows per risk band; all three bands are always present.

    One global aggregate (partial per partition) and a ``stack`` unpivot.
    """
    band = risk_band(SCORE, cuts)
    one = df.agg(count_if(band == "low").alias("low"), count_if(band == "medium").alias("medium"),
                 count_if(band == "high").alias("high"))
    return one.select(F.expr("stack(3, 'low', low, 'medium', medium, 'high', high) as (band, n)"))


def score_bin(bins: int = 20) -> Column:
    return F.least(F.floor(F.col(SCORE) * bins), F.lit(bins - 1)).cast("int")


def score_histogram(df: DataFrame, bins: int = 20, with_height: bool = False) -> DataFrame:
    """Rows per score bin of width 1/bins, empty bins included.

    The aggregate has at most ``bins`` rows, so joining it to the generated
    bin list is a join of two tiny frames.
    """
    spark = df.sparkSession
    counts = df.groupBy(score_bin(bins).alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    h = (all_bins.join(F.broadcast(counts), "bin", "left")
         .select("bin",
                 F.format_string("%.2f-%.2f", F.col("bin") * (1.0 / bins), (F.col("bin") + 1) * (1.0 / bins)).alias("bin_label"),
                 F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))
    if with_height:
        total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over <= bins rows
        per_bin = F.greatest(F.lit(1.0), total.cast("double") / bins)
        h = h.withColumn("height", F.least(F.lit(100), F.floor(F.col("n") / per_bin * 100)).cast("int"))
    return h


ALERT_ORDER = ["unix_time", "trans_key", "cc_num", "amt", SCORE, "merchant"]


def iso_utc(epoch_seconds: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-ddTHH:mm:ssZ`` in UTC, whatever the session time zone."""
    shifted = F.to_utc_timestamp(F.timestamp_seconds(epoch_seconds), F.current_timezone())
    return F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def alert_projection(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """F24 (+F22, F23): the alert record of every flagged row."""
    cols = [F.round(F.col(SCORE).cast("decimal(12,4)"), 3).cast("double").alias("risk_score"),
            F.coalesce(F.col("merchant"), F.lit("Unknown")).alias("merchant"), "category",
            F.round(F.col("amt").cast(MONEY), 2).cast("double").alias("amount"),
            "cc_num", mask_card("cc_num").alias("cc_num_masked"), "state",
            F.coalesce(F.col("first"), F.lit("Unknown")).alias("first"),
            F.coalesce(F.col("last"), F.lit("Unknown")).alias("last"),
            iso_utc(F.col("unix_time")).alias("timestamp")]
    if as_of is not None:
        cols.append(seconds_ago("unix_time", as_of).alias("seconds_ago"))
    return high_risk(df).select(*cols)


def alerts_with_age(df: DataFrame) -> DataFrame:
    """Alerts with ``seconds_ago`` against the newest scored row (one-row aggregate, broadcast)."""
    newest = df.agg(F.max("unix_time").alias("as_of"), F.lit(1).alias("_one"))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(newest), "_one")
    return alert_projection(joined, F.col("as_of"))


def recent_alerts(df: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` alerts (order + limit: TakeOrderedAndProject keeps n rows per task)."""
    top = high_risk(df).orderBy(*[F.col(c).desc() for c in ALERT_ORDER]).limit(n)
    return alert_projection(top)


def alert_volume_by_category(df: DataFrame) -> DataFrame:
    """Flagged amount by category, largest first."""
    return (high_risk(df).groupBy("category").agg(money_sum("amt").alias("amount"))
            .orderBy(F.col("amount").desc(), "category"))


def top_category(df: DataFrame) -> DataFrame:
    """A10: category holding the most flagged amount (ties: smallest name)."""
    return (category_risk(df).orderBy(F.col("flagged_amount").desc(), "category").limit(1)
            .select(F.col("category").alias("top_category"), F.col("flagged_amount").alias("top_category_amount")))


def state_rank(df: DataFrame, k: int = 8) -> DataFrame:
    """States ranked by flagged amount, first ``k`` ranks (ties share a rank).

    The window runs over the per-state aggregate, one row per state.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("flagged_amount").desc())
    return (state_risk(df).withColumn("rank", F.rank().over(w).cast("int")).where(F.col("rank") <= k)
            .select("rank", "state", F.col("flagged_amount").alias("fraud_amount"), F.col("flagged_count").alias("count")))


CONCENTRATION_ORDER = [SCORE, "unix_time", "trans_key", "amt"]
SCORE_BINS = 10_000


def _fine_bin() -> Column:
    """Bin of the score, rising with it; rows without a score (null or NaN) are in bin -1."""
    s = F.col(SCORE).cast("double")
    clipped = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    return F.when(s.isNull() | F.isnan(s), F.lit(-1)).otherwise(F.floor(clipped * SCORE_BINS)).cast("int")


def _cells(df: DataFrame, threshold: float, by: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """One row per fine score bin (and ``by``): counts, exact amounts and times, from one scan of
    ``df``.  Written to the shared folder, as several small results come from it."""
    f, amt = flagged(threshold), F.col("amt").cast(MONEY)
    cells = df.groupBy(_fine_bin().alias("bin"), *[F.coalesce(c, F.lit("unknown")).alias(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amt).alias("amount"), F.count(F.when(f, 1)).alias("flagged"),
        F.sum(F.when(f, amt)).alias("flagged_amount"), F.min("unix_time").alias("first_time"),
        F.max("unix_time").alias("last_time"), *more)
    path = checkpoint_path(df.sparkSession, "cells", uuid.uuid4().hex)
    cells.write.parquet(path)
    return df.sparkSession.read.schema(cells.schema).parquet(path)


def _top_flagged_amount(df: DataFrame, cells: DataFrame, p: float, threshold: float) -> tuple[Decimal, int]:
    """Flagged amount of the top k = max(1, floor(n*p)) rows by score (desc, tie keys desc), and k.

    The bins (at most ``SCORE_BINS`` + 2 rows) tell which of them lies across the cut; only its rows are
    read again, and the cut inside it is exact (``selection``).  Rows without a score are in no top k."""
    bins = cells.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("flagged_amount").alias("amount")).collect()
    n = sum(r["n"] for r in bins)
    k = max(1, int(n * p)) if n else 0
    left, top = k, Decimal(0)
    for r in sorted((r for r in bins if r["bin"] >= 0), key=lambda r: -r["bin"]):
        if r["n"] > left:
            top += _top_of_bin(df, r["bin"], left, r["n"], threshold) if left else 0
            break
        top += r["amount"] or 0
        left -= r["n"]
    return top, k


def _top_of_bin(df: DataFrame, bin_: int, k: int, n: int, threshold: float) -> Decimal:
    """Flagged amount of the first ``k`` of the ``n`` rows in one score bin."""
    inside = _fine_bin() == bin_
    if 0 < bin_ < SCORE_BINS:  # a plain range on the score, which reaches the scan
        inside = F.col(SCORE).between((bin_ - 1) / SCORE_BINS, (bin_ + 2) / SCORE_BINS) & inside
    names = [f"_k{i}" for i in range(len(CONCENTRATION_ORDER))]
    band = df.where(inside).select(SCORE, "amt", *[(-F.col(c).cast("double") if c == "amt" else -F.col(c)).alias(k_)
                                                   for c, k_ in zip(CONCENTRATION_ORDER, names)]).persist()
    try:
        cut = kth_cut(band, names, k, n=n)
        above = band.where(below_cut(band, names, cut) & flagged(threshold)).agg(F.sum(F.col("amt").cast(MONEY))).first()[0]
    finally:
        band.unpersist(blocking=True)
    # rows equal in every order key are interchangeable
    at_amount = Decimal(0) if cut.key[3] is None else Decimal(repr(-cut.key[3])).quantize(Decimal("0.01"))
    return (above or Decimal(0)) + (cut.take * at_amount if -cut.key[0] >= threshold else 0)


def _money_of(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast(MONEY)).cast("double")


def _count_of(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _literal(amount: Decimal) -> Column:
    return F.lit(str(amount)).cast("decimal(38,2)").cast("double")


def _share(top: Column, total: Column) -> Column:
    return F.when(total > 0, top / F.greatest(F.lit(1.0), total) * 100).otherwise(F.lit(0.0))


def risk_concentration(df: DataFrame, p: float = 0.01, threshold: float = FRAUD_THRESHOLD) -> DataFrame:
    """Share of the flagged amount held by the top ``p`` of rows by score.

    k = max(1, floor(n*p)).  One aggregate by fine score bin finds the bin in
    which the k-th row lies; only the rows of that bin are read a second time.
    """
    cells = _cells(df, threshold)
    top, k = _top_flagged_amount(df, cells, p, threshold)
    return cells.agg(_money_of("flagged_amount").alias("fraud_amount")).select(
        F.lit(k).cast("bigint").alias("top_count"), _literal(top).alias("top_fraud_amount"), "fraud_amount",
        _share(_literal(top), F.col("fraud_amount")).alias("concentration_pct"))


def business_summary(df: DataFrame, threshold: float = FRAUD_THRESHOLD, p: float = 0.01) -> DataFrame:
    """A18 (with A14-A17, A10, A13): the KPI row.  One aggregate by fine score
    bin and category holds every measure; a second scan reads only the score
    bin across the top-k cut."""
    cells = _cells(df, threshold, ("category",))
    return _summary(cells, _top_flagged_amount(df, cells, p, threshold)[0])


def _summary(cells: DataFrame, top: Decimal) -> DataFrame:
    base = cells.agg(
        _count_of("n").alias("transactions_analyzed"), _money_of("amount").alias("total_amount"),
        _count_of("flagged").alias("high_risk_count"), _money_of("flagged_amount").alias("fraud_exposure_identified"),
        ((F.max("last_time") - F.min("first_time")) / 3600.0).alias("elapsed_hours"))
    n = F.col("transactions_analyzed")
    fr = F.col("fraud_exposure_identified") / F.greatest(F.lit(1.0), F.col("total_amount"))
    out = base.select(
        "transactions_analyzed", "total_amount", "high_risk_count", "fraud_exposure_identified",
        fr.alias("fraud_rate"), (fr * 100).alias("fraud_rate_pct"),
        F.floor(F.col("high_risk_count") / F.greatest(F.lit(1), n).cast("double") * 1e6).cast("bigint").alias("alerts_per_million"),
        (F.col("high_risk_count") / F.greatest(F.lit(1), n).cast("double")).alias("high_risk_txn_rate"),
        F.when(F.coalesce(F.col("elapsed_hours"), F.lit(0.0)) != 0,
               F.col("fraud_exposure_identified") / F.greatest(F.lit(0.001), F.col("elapsed_hours")) * 8760)
         .otherwise(F.lit(0.0)).alias("projected_annual_savings"),
        _share(_literal(top), F.col("fraud_exposure_identified")).alias("concentration_pct"),
        F.lit(1).alias("_one"))
    per = cells.groupBy("category").agg(F.sum("flagged").alias("n"), _money_of("flagged_amount").alias("top_category_amount")).where("n > 0")
    top_cat = (per.orderBy(F.col("top_category_amount").desc(), "category").limit(1)
               .select(F.col("category").alias("top_category"), "top_category_amount", F.lit(1).alias("_one")))
    return out.join(top_cat, "_one", "left").drop("_one")


def fraud_split(df: DataFrame, threshold: float = FRAUD_THRESHOLD) -> DataFrame:
    """Flagged rows vs the rest (never negative)."""
    one = df.agg(count_if(flagged(threshold)).alias("fraud"), F.count(F.lit(1)).cast("bigint").alias("n"))
    return one.select("fraud", F.greatest(F.lit(0), F.col("n") - F.col("fraud")).cast("bigint").alias("legit"))


def business_kpis(df: DataFrame, threshold: float = FRAUD_THRESHOLD, eval_threshold: float = 0.5,
                  label: str = "is_fraud", batch_seconds: int = 86400, folded: DataFrame | None = None) -> DataFrame:
    """The dashboard's 17 KPIs.  From scored rows: exposure, volume, flagged
    count, precision/recall/FPR at the evaluation threshold, fraud rate,
    alerts per million, high-risk rate, projected savings, band counts (one KPI),
    concentration, fraud velocity per minute over the newest batch window
    (its flagged rows by the minutes of it that have passed, one at least), and flagged
    rows per category and per state as maps.  From the ``folded`` metric store: the median decision
    latency (counters of ``sketch.sketch_rows`` named ``decision_latency_ms``) and the storage utilisation (gauge
    ``storage_util_pct``); where the store has none they are null and their ``_known`` flag is false."""
    pred = F.col(SCORE) > eval_threshold
    y = F.col(label) == 1
    band = risk_band(SCORE)
    counts = {"_tp": pred & y, "_fp": pred & ~y, "_fn": ~pred & y, "_tn": ~pred & ~y,
              "risk_low": band == "low", "risk_medium": band == "medium", "risk_high": band == "high"}
    cells = _cells(df, threshold, ("category",), tuple(F.count(F.when(c, 1)).alias(n) for n, c in counts.items()))
    s = _summary(cells, _top_flagged_amount(df, cells, 0.01, threshold)[0])
    newest = cells.agg(F.max("last_time")).first()[0]
    start = (newest // batch_seconds) * batch_seconds if newest is not None else 0
    last = df.where(F.col("unix_time") >= F.lit(start)).agg(count_if(flagged(threshold)).alias("_last_flagged"), F.lit(1).alias("_one"))
    one = cells.agg(*[_count_of(n).alias(n) for n in counts], F.lit(1).alias("_one")).join(last, "_one")
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("_tp", "_fp", "_fn", "_tn"))
    one = one.select(
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision_at_threshold"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall"),
        F.when(fp + tn > 0, fp / (fp + tn)).otherwise(F.lit(0.0)).alias("false_positive_rate"),
        "risk_low", "risk_medium", "risk_high",
        (F.col("_last_flagged") / max(1.0, ((newest or 0) - start) / 60.0)).alias("fraud_velocity_per_min"),
        F.lit(1).alias("_one"))
    kpi = s.select(
        F.col("fraud_exposure_identified").alias("fraud_exposure_identified_usd"), "transactions_analyzed",
        F.col("high_risk_count").alias("high_risk_flagged"), "fraud_rate_pct",
        F.col("alerts_per_million").alias("alerts_per_1m"), "high_risk_txn_rate",
        F.col("projected_annual_savings").alias("annual_savings_usd"),
        F.col("concentration_pct").alias("risk_concentration_pct"), F.lit(1).alias("_one"))
    def map_of(rows: DataFrame, key: str, name: str) -> DataFrame:  # one row: a map of few names
        entries = F.collect_list(F.when(F.col("flagged_count") > 0, F.struct(key, "flagged_count")))
        return rows.agg(F.map_from_entries(F.array_sort(entries)).alias(name), F.lit(1).alias("_one"))

    categories = cells.groupBy("category").agg(F.sum("flagged").cast("bigint").alias("flagged_count"))
    states = state_risk(df, threshold).select(F.coalesce("state", F.lit("unknown")).alias("state"), "flagged_count")
    kpi = (kpi.join(one, "_one").join(map_of(categories, "category", "category_risk"), "_one")
           .join(map_of(states, "state", "state_risk"), "_one"))
    if folded is None:
        return kpi.select("*", F.lit(None).cast("double").alias("decision_latency_ms"), F.lit(False).alias("decision_latency_known"),
                          F.lit(None).cast("double").alias("storage_util_pct"), F.lit(False).alias("storage_util_known")).drop("_one")
    latency = sketch_quantiles(folded, "decision_latency_ms", {"decision_latency_ms": 0.5}).select(
        "decision_latency_ms", (F.col("n") > 0).alias("decision_latency_known"), F.lit(1).alias("_one"))
    util = folded.where((F.col("kind") == "gauge") & (F.col("name") == "storage_util_pct")).agg(
        F.max("value").cast("double").alias("storage_util_pct"), (F.count("value") > 0).alias("storage_util_known"), F.lit(1).alias("_one"))
    return kpi.join(latency, "_one").join(util, "_one").drop("_one")  # single rows


def totals(df: DataFrame, threshold: float = FRAUD_THRESHOLD) -> DataFrame:
    """A2/A3: rows scored and amount; flagged rows and flagged amount."""
    f = flagged(threshold)
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("total_txns_scored"),
                  money_sum("amt").alias("total_amount_processed"),
                  count_if(f).alias("fraud_blocked_count"),
                  money_sum("amt", f).alias("total_fraud_amount_identified"))
