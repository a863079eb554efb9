"""Log-line parsing as column expressions.

Everything is built from ``split``/``transform``/``filter``/``try_cast``,
so a parsing job is one projection over a text column and runs inside
whole-stage codegen; no Python touches a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = "[TELEMETRY]"

# Typed keys of a telemetry record.
TEXT_KEYS = ["stage", "status"]
INT_KEYS = ["rows", "throughput", "fraud_blocked"]
FLOAT_KEYS = ["elapsed", "cpu_cores", "ram_gb", "ram_percent"]
# Keys written by the longer stage records (kept in ``extra``).
EXTRA_KEYS = ["cpu_tps", "gpu_tps", "fb_read", "fb_write", "cpu_util", "gpu_util", "io_wait"]


def telemetry_entries(line: Column) -> Column:
    """array<struct<key, value>> of the ``key=value`` parts of a telemetry line:
    parts split on '|', trimmed, tag removed, split at the first '='."""
    parts = F.transform(F.split(line, r"\|"), lambda p: strip(F.replace(strip(p), F.lit(TAG), F.lit(""))))
    kv = F.filter(parts, lambda p: F.instr(p, "=") > 0)
    return F.transform(kv, lambda p: F.struct(
        strip(F.substring_index(p, "=", 1)).alias("key"),
        strip(F.substr(p, F.instr(p, "=") + 1)).alias("value")))


NUMBER_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:nan|inf|infinity)$"


def key_value_arrays(parts: Column) -> tuple[Column, Column]:
    """Names and values of the ``name=value`` parts of a tag-free line cut at '|', newest part first.  A
    part's name is the text before its first '=', white space trimmed; parts without one have no name."""
    newest = F.reverse(parts)
    name = lambda p: F.when(F.instr(p, "=") > 0, strip(F.substring_index(p, "=", 1)))
    return F.transform(newest, name), F.transform(newest, lambda p: F.substr(p, F.instr(p, "=") + 1))


def key_value(names: Column, values: Column, key: str) -> Column:
    """Value of the last part named ``key`` (later parts overwrite earlier ones), or null."""
    pos = F.array_position(names, F.lit(key))
    return F.when(pos > 0, strip(F.element_at(values, pos.cast("int"))))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def parse_telemetry(df: DataFrame, line: str = "line", keep: list[str] | None = None,
                    with_extra: bool = False) -> DataFrame:
    """Typed telemetry records from log lines.

    Lines without the tag are dropped.  ``rows``, ``throughput`` and
    ``fraud_blocked`` are integers; ``elapsed``, ``cpu_cores``, ``ram_gb``,
    ``ram_percent`` doubles.  A value that does not parse voids the whole line
    (the line goes to ``bad_telemetry`` instead).  Other keys are kept in
    ``extra`` (map) when ``with_extra``.
    """
    parsed = _parse(df, line, keep, with_extra)
    return keep_rows(parsed, ~F.col("_bad"), [c for c in parsed.columns if c != "_bad"])


def bad_telemetry(df: DataFrame, line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """Tagged lines that did not parse, with their text."""
    parsed = _parse(df, line, (keep or []) + [line], False)
    return keep_rows(parsed, F.col("_bad"), [*(keep or []), line])


def keep_rows(df: DataFrame, cond: Column, cols: list[str]) -> DataFrame:
    """Rows where ``cond`` holds, as a generator instead of a filter.

    A filter on a parsed column is pushed below the projection and would
    re-evaluate the parsing expressions once per reference; a generator is
    a barrier for that rewrite, so each line is parsed once.
    """
    one = F.when(cond, F.array(F.struct(*[F.col(c) for c in cols])))
    return df.select(F.explode(one).alias("_r")).select("_r.*")


def _parse(df: DataFrame, line: str, keep: list[str] | None, with_extra: bool) -> DataFrame:
    return with_telemetry(df.where(F.instr(F.col(line), TAG) > 0), line, keep, with_extra)


def with_telemetry(df: DataFrame, line: str = "line", keep: list[str] | None = None,
                   with_extra: bool = False) -> DataFrame:
    """Parsed record columns for every line (null for untagged lines) plus
    ``_bad`` (tagged line with a value that does not parse)."""
    keep = [k for k in (keep or []) if k in df.columns]
    tagged = F.instr(F.col(line), TAG) > 0
    clean = F.replace(F.col(line), F.lit(TAG), F.lit(""))
    d = df.select(*keep, *([] if line in keep else [line]), tagged.alias("_tagged"), F.when(tagged, F.split(clean, r"\|")).alias("_parts"))
    names, values = key_value_arrays(F.col("_parts"))
    d = d.select(*keep, *([] if line in keep else [line]), "_tagged", names.alias("_k"), values.alias("_v"))
    typed_keys = [*[(k, "bigint") for k in INT_KEYS], *[(k, "double") for k in FLOAT_KEYS]]
    # one projection per step: each raw string and each cast is computed once
    # and read by reference afterwards (CollapseProject keeps non-cheap
    # expressions that are read more than once in their own projection)
    d = d.select(*keep, *([] if line in keep else [line]), "_tagged", *(["_k", "_v"] if with_extra else []),
                 *[key_value(F.col("_k"), F.col("_v"), k).alias(f"_raw_{k}") for k in TEXT_KEYS + [k for k, _ in typed_keys]])
    d = d.select("*", *[F.col(f"_raw_{k}").try_cast(t).alias(f"_typed_{k}") for k, t in typed_keys])
    out = [F.col(k) for k in keep]
    bad = F.lit(False)
    for k in TEXT_KEYS:
        out.append(F.col(f"_raw_{k}").alias(k))
    for k, _ in typed_keys:
        raw, typed = F.col(f"_raw_{k}"), F.col(f"_typed_{k}")
        # a number written as Spark writes it needs no look at its form
        bad = bad | (raw.isNotNull() & (typed.isNull() | ((raw != typed.cast("string")) & ~raw.rlike(NUMBER_RE))))
        out.append(F.col(f"_typed_{k}").alias(k))
    if with_extra:
        d = d.withColumn("_e", F.when(tagged, telemetry_entries(F.col(line))))
        known = F.array(*[F.lit(k) for k in TEXT_KEYS + INT_KEYS + FLOAT_KEYS])
        others = F.filter(F.col("_e"), lambda e: ~F.array_contains(known, e["key"]))
        # a repeated key keeps its last value
        last = F.filter(others, lambda e, i: ~F.exists(F.slice(others, i + 2, F.size(others)), lambda x: x["key"] == e["key"]))
        out.append(F.map_from_arrays(F.transform(last, lambda e: e["key"]),
                                     F.transform(last, lambda e: e["value"])).alias("extra"))
    return d.select(*out, (F.col("_tagged") & bad).alias("_bad"))


def emit_telemetry(stage: Column, status: Column, rows: Column, throughput: Column, elapsed: Column,
                   cpu_cores: Column, ram_gb: Column, ram_percent: Column) -> Column:
    """T4: a metrics row -> one telemetry line (the format the parser reads)."""
    return F.format_string(
        "[TELEMETRY] stage=%s | status=%s | rows=%d | throughput=%d | elapsed=%.1f | cpu_cores=%.1f | ram_gb=%.2f | ram_percent=%.1f",
        stage, status, rows.cast("bigint"), throughput.cast("bigint"), elapsed.cast("double"),
        cpu_cores.cast("double"), ram_gb.cast("double"), ram_percent.cast("double"))


METRICS_RE = r"METRICS: Rows=(\d+) \| Time=([0-9.]+)s \| Throughput=([0-9.]+)"


def parse_metrics_line(df: DataFrame, line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """T5: the final ``METRICS: Rows=.. | Time=..s | Throughput=..`` summary line."""
    keep = keep or []
    m = F.col(line).rlike(METRICS_RE)
    return df.where(m).select(
        *keep,
        F.regexp_extract(line, METRICS_RE, 1).try_cast("bigint").alias("rows"),
        F.regexp_extract(line, METRICS_RE, 2).try_cast("double").alias("time_s"),
        F.regexp_extract(line, METRICS_RE, 3).try_cast("double").alias("throughput"))


def parse_usage(df: DataFrame, line: str = "line") -> DataFrame:
    """``kubectl top pods`` lines -> (pod, app, cpu_millicores, mem_mib).

    app = pod name without its last two '-' parts (when it has two dashes);
    cpu '100m' -> 100, '2' -> 2; memory '250Mi' -> 250, bare digits as is.
    Lines with fewer than three fields are skipped; unparsable numbers give null.
    """
    parts = F.split(F.trim(F.col(line)), r"\s+")
    d = df.select(parts.alias("_p")).where(F.size("_p") >= 3)
    pod = F.col("_p")[0]
    dashes = F.split(pod, "-")
    app = F.when(F.size(dashes) >= 3, F.array_join(F.slice(dashes, 1, F.size(dashes) - 2), "-")).otherwise(pod)
    cpu_raw, mem_raw = F.col("_p")[1], F.col("_p")[2]
    cpu = F.when(cpu_raw.endswith("m"), F.expr("substring(_p[1], 1, length(_p[1]) - 1)")).otherwise(cpu_raw)
    mem = F.when(mem_raw.endswith("Mi"), F.expr("substring(_p[2], 1, length(_p[2]) - 2)")).otherwise(mem_raw)
    return d.select(pod.alias("pod"), app.alias("app"), cpu.try_cast("bigint").alias("cpu_millicores"),
                    mem.try_cast("bigint").alias("mem_mib"))


QUANTITY_RE = r"(?i)^(\d+)([KMGT]i?)?$"
# Unit factors in bytes; with "i" binary, without it decimal.
UNIT_BYTES = {"k": 1000, "m": 1000 ** 2, "g": 1000 ** 3, "t": 1000 ** 4,
              "ki": 1024, "mi": 1024 ** 2, "gi": 1024 ** 3, "ti": 1024 ** 4}


def cpu_millicores(q: Column) -> Column:
    """T3: '8' -> 8000, '8000m' -> 8000; anything else -> null."""
    milli = F.regexp_extract(q, r"^(\d+)m$", 1)
    whole = F.regexp_extract(q, r"^(\d+)$", 1)
    return (F.when(milli != "", milli.try_cast("bigint"))
             .when(whole != "", whole.try_cast("bigint") * 1000))


def memory_bytes(q: Column, bare: str = "Ki") -> Column:
    """T3: '<n>[K|M|G|T][i]' in any case -> bytes; anything else, or what exceeds a long, -> null.

    ``bare`` is the unit of a number without one: Ki in node listings, Gi in the scaler's limits."""
    unit = F.lower(F.regexp_extract(q, QUANTITY_RE, 2))
    table = F.create_map(*[F.lit(x) for u, f in (UNIT_BYTES | {"": UNIT_BYTES[bare.lower()]}).items() for x in (u, f)])
    return F.try_multiply(F.regexp_extract(q, QUANTITY_RE, 1).try_cast("bigint"), table[unit])


def memory_gib(q: Column, bare: str = "Gi") -> Column:
    """Whole GiB of a memory limit, at least 1 (the scaler's bound rule)."""
    b = memory_bytes(q, bare)
    return F.when(b.isNotNull(), F.greatest(F.lit(1), F.call_function("div", b, F.lit(1024 ** 3)))).cast("bigint")
