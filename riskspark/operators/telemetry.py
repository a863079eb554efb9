"""Stage measures from parsed telemetry records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TAG
from .windows import trailing_aggregate


def stage_counters(parsed: DataFrame, order: str = "line_no") -> DataFrame:
    """Per stage the running maximum of ``rows`` (counters never go back),
    the newest status, the number of records and the newest record's line."""
    return parsed.groupBy("stage").agg(
        F.max("rows").alias("max_rows"),
        F.max_by("status", order).alias("last_status"),
        F.count(F.lit(1)).cast("bigint").alias("n_records"),
        F.max(order).alias("last_line_no"))


def stage_throughput(parsed: DataFrame) -> DataFrame:
    """Rows / elapsed, 0 when elapsed <= 0 or missing."""
    e = F.col("elapsed")
    return parsed.withColumn("rows_per_s", F.when(e > 0, F.col("rows") / e).otherwise(F.lit(0.0)))


def previous_stage_rows(lines: DataFrame, stage_of: str = "stage", lookback: int = 100) -> DataFrame:
    """For each telemetry record, the row count of the newest telemetry
    line among the ``lookback`` lines before it, when that line belongs to a
    different stage (else 0) -- the "preserve total" rule of a stage that
    continues another stage's count.  ``total_rows`` = that + own rows.

    ``lines``: (log, line_no, line, stage, rows) where stage/rows are the
    parsed values of the line (null for lines that are not records).  The
    newest earlier line is found with a bucketed trailing window, so a single
    long log is not one task.
    """
    tagged = F.instr(F.col("line"), TAG) > 0
    is_rec = tagged & (F.instr(F.col("line"), "stage=") > 0)
    rows_part = F.filter(F.split(F.col("line"), r"\|"), lambda p: F.instr(p, "rows=") > 0)
    first_rows = F.when(F.size(rows_part) > 0, F.trim(F.split(F.element_at(rows_part, 1), "=")[1]))
    # what follows each "stage=" up to the end of its field stands for the text in the shuffle
    stages = F.regexp_extract_all(F.col("line"), F.lit(r"(?=stage=([^|]*))"), F.lit(1))
    rec = F.struct(F.col("line_no").alias("line_no"), stages.alias("stages"), first_rows.try_cast("bigint").alias("rows"))
    d = lines.select("log", "line_no", stage_of, "rows", F.when(is_rec, rec).alias("_rec"))
    # newest record before the current line: a running value, whose distance is tested after
    j = trailing_aggregate(
        d, ["log"], "line_no", lookback,
        {"_prev_excl": lambda w: F.last("_rec", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1))})
    p = F.col("_prev_excl")
    near = p["line_no"] >= F.col("line_no") - lookback
    same = F.exists(p["stages"], lambda s: F.startswith(s, F.col(stage_of)))
    previous = F.when(p.isNotNull() & near & ~same & p["rows"].isNotNull(), p["rows"]).otherwise(F.lit(0))
    out = j.where(F.col(stage_of).isNotNull()).select(
        "log", "line_no", stage_of, "rows", previous.cast("bigint").alias("previous_total"),
        (previous + F.col("rows")).cast("bigint").alias("total_rows"))
    return out
