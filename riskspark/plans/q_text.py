"""Text-parsing queries (T1-T5, A22-A24) over the log-line stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import telemetry as tm
from ..sources import fixtures as fx
from .catalog import register

LINES = f"lines as ({fx.telemetry_lines_sql()})"
INT_OK = "case when regexp_matches({v}, '^[+-]?[0-9]+$') then try_cast({v} as bigint) end"
ENTRIES = """list_transform(
    list_filter(list_transform(string_split(line, '|'), lambda x: trim(replace(trim(x), '[TELEMETRY]', ''))),
                lambda x: instr(x, '=') > 0),
    lambda x: {'key': trim(split_part(x, '=', 1)), 'value': trim(substr(x, instr(x, '=') + 1))})"""


def _val(k: str) -> str:
    return f"list_filter(e, lambda x: x.key = '{k}')[-1].value"


PARSED = f"""{LINES},
ent as (select log, line_no, line, {ENTRIES} as e from lines where instr(line, '[TELEMETRY]') > 0),
raw as (select log, line_no, line, {', '.join(f"{_val(k)} as r_{k}" for k in tx.TEXT_KEYS + tx.INT_KEYS + tx.FLOAT_KEYS)} from ent),
typed as (select log, line_no, line, r_stage as stage, r_status as status,
  {', '.join(INT_OK.format(v=f'r_{k}') + f' as {k}' for k in tx.INT_KEYS)},
  {', '.join(f'try_cast(r_{k} as double) as {k}' for k in tx.FLOAT_KEYS)},
  ({' or '.join(f'(r_{k} is not null and {INT_OK.format(v=f"r_{k}")} is null)' for k in tx.INT_KEYS)}
   or {' or '.join(f'(r_{k} is not null and try_cast(r_{k} as double) is null)' for k in tx.FLOAT_KEYS)}) as bad
  from raw)"""
COLS = ", ".join(["log", "line_no", *tx.TEXT_KEYS, *tx.INT_KEYS, *tx.FLOAT_KEYS])


def _parsed(spark, sf):
    return tx.parse_telemetry(fx.telemetry_lines(spark, sf), keep=["log", "line_no"])


@register("telemetry_parse", f"with {PARSED}\nselect {COLS} from typed where not bad")
def telemetry_parse(spark, sf):
    return _parsed(spark, sf)


@register("telemetry_bad", f"with {PARSED}\nselect log, line_no, line from typed where bad")
def telemetry_bad(spark, sf):
    return tx.bad_telemetry(fx.telemetry_lines(spark, sf), keep=["log", "line_no"])


@register("telemetry_extra", f"""with {LINES},
ent as (select line_no, {ENTRIES} as e from lines where instr(line, '[TELEMETRY]') > 0)
select line_no, {_val('cpu_tps')} as cpu_tps from ent""")
def telemetry_extra(spark, sf):
    """Keys outside the typed set are kept in ``extra`` (here: cpu_tps)."""
    p = tx.with_telemetry(fx.telemetry_lines(spark, sf).where(F.instr("line", tx.TAG) > 0),
                          keep=["line_no"], with_extra=True)
    return p.select("line_no", F.col("extra").getItem("cpu_tps").alias("cpu_tps"))


@register("telemetry_emit", f"""with {PARSED}
select line_no, printf('[TELEMETRY] stage=%s | status=%s | rows=%d | throughput=%d | elapsed=%.1f | cpu_cores=%.1f | ram_gb=%.2f | ram_percent=%.1f',
  stage, status, rows, throughput, elapsed, cpu_cores, ram_gb, ram_percent) as line
from typed where not bad and rows is not null and throughput is not null""")
def telemetry_emit(spark, sf):
    p = _parsed(spark, sf).where(F.col("rows").isNotNull() & F.col("throughput").isNotNull())
    return p.select("line_no", tx.emit_telemetry(*[F.col(c) for c in (
        "stage", "status", "rows", "throughput", "elapsed", "cpu_cores", "ram_gb", "ram_percent")]).alias("line"))


@register("stage_counters", f"""with {PARSED}
select stage, max(rows) as max_rows, arg_max(status, line_no) as last_status, cast(count(*) as bigint) as n_records,
  max(line_no) as last_line_no
from typed where not bad group by stage""")
def stage_counters(spark, sf):
    return tm.stage_counters(_parsed(spark, sf))


@register("stage_throughput", f"""with {PARSED}
select line_no, stage, rows, elapsed, case when elapsed > 0 then rows / elapsed else 0.0 end as rows_per_s
from typed where not bad""")
def stage_throughput(spark, sf):
    return tm.stage_throughput(_parsed(spark, sf)).select("line_no", "stage", "rows", "elapsed", "rows_per_s")


@register("previous_stage_rows", f"""with {PARSED},
al as (select l.log, l.line_no, l.line, t.stage, t.rows, t.bad,
              instr(l.line, '[TELEMETRY]') > 0 and instr(l.line, 'stage=') > 0 as is_rec
       from lines l left join typed t on l.line_no = t.line_no),
w as (select *, last_value(case when is_rec then line end ignore nulls)
                  over (partition by log order by line_no range between 100 preceding and 1 preceding) as prev_line
      from al),
r as (select *, {INT_OK.format(v="trim(split_part(list_filter(string_split(prev_line, '|'), lambda p: instr(p, 'rows=') > 0)[1], '=', 2))")} as prev_rows
      from w)
select log, line_no, stage, rows,
  cast(case when prev_line is not null and instr(prev_line, 'stage=' || stage) = 0 and prev_rows is not null then prev_rows else 0 end as bigint) as previous_total,
  cast(rows + case when prev_line is not null and instr(prev_line, 'stage=' || stage) = 0 and prev_rows is not null then prev_rows else 0 end as bigint) as total_rows
from r where stage is not null and not bad""")
def previous_stage_rows(spark, sf):
    lines = tx.with_telemetry(fx.telemetry_lines(spark, sf), keep=["log", "line_no", "line"])
    lines = lines.withColumn("stage", F.when(~F.col("_bad"), F.col("stage"))).drop("_bad")
    return tm.previous_stage_rows(lines)


@register("metrics_parse", f"""with m as ({fx.metrics_lines_sql()})
select line_no, try_cast(regexp_extract(line, '{tx.METRICS_RE}', 1) as bigint) as rows,
  try_cast(regexp_extract(line, '{tx.METRICS_RE}', 2) as double) as time_s,
  try_cast(regexp_extract(line, '{tx.METRICS_RE}', 3) as double) as throughput
from m where regexp_matches(line, '{tx.METRICS_RE}')""")
def metrics_parse(spark, sf):
    return tx.parse_metrics_line(fx.metrics_lines(spark, sf), keep=["line_no"])


USAGE = f"""u as ({fx.usage_lines_sql()}),
p as (select string_split_regex(trim(line), '\\s+') as parts from u),
q as (select parts[1] as pod, string_split(parts[1], '-') as d, parts[2] as c, parts[3] as m from p where len(parts) >= 3),
usage as (select pod, case when len(d) >= 3 then array_to_string(d[1:len(d) - 2], '-') else pod end as app,
  {INT_OK.format(v="case when ends_with(c, 'm') then left(c, length(c) - 1) else c end")} as cpu_millicores,
  {INT_OK.format(v="case when ends_with(m, 'Mi') then left(m, length(m) - 2) else m end")} as mem_mib from q)"""


@register("usage_parse", f"with {USAGE}\nselect pod, app, cpu_millicores, mem_mib from usage")
def usage_parse(spark, sf):
    return tx.parse_usage(fx.usage_lines(spark, sf))


@register("quantity_parse", f"""with q as ({fx.quantities_sql()}),
p as (select id, cpu, memory, try_cast(regexp_extract(memory, '^([0-9]+)([KkMmGgTt][Ii]?)?$', 1) as hugeint) as n,
        lower(regexp_extract(memory, '^([0-9]+)([KkMmGgTt][Ii]?)?$', 2)) as unit from q),
f as (select *, case unit when 'k' then 1000 when 'm' then 1000000 when 'g' then 1000000000 when 't' then 1000000000000
        when 'ki' then 1024 when 'mi' then 1048576 when 'gi' then 1073741824 when 'ti' then 1099511627776 end as factor from p),
b as (select *, try_cast(n * coalesce(factor, 1024) as bigint) as memory_bytes,
        try_cast(n * coalesce(factor, 1073741824) as bigint) as limit_bytes from f)
select id, cpu, memory,
  case when regexp_extract(cpu, '^(\\d+)m$', 1) != '' then cast(regexp_extract(cpu, '^(\\d+)m$', 1) as bigint)
       when regexp_extract(cpu, '^(\\d+)$', 1) != '' then cast(regexp_extract(cpu, '^(\\d+)$', 1) as bigint) * 1000 end as cpu_millicores,
  memory_bytes, case when limit_bytes is not null then cast(greatest(1, limit_bytes // 1073741824) as bigint) end as limit_gib
from b""")
def quantity_parse(spark, sf):
    """Cpu and memory quantities of node listings, and the same text read as a scaler's limit in GiB."""
    q = fx.quantities(spark, sf)
    return q.select("id", "cpu", "memory", tx.cpu_millicores(F.col("cpu")).alias("cpu_millicores"),
                    tx.memory_bytes(F.col("memory")).alias("memory_bytes"), tx.memory_gib(F.col("memory")).alias("limit_gib"))
