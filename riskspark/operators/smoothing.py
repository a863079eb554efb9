"""Exponential smoothing with reset (W3): an ordered fold, split over tasks by speculation.

The rule is ``new = x`` where ``|x - old| > reset``, else ``old * (1 - alpha) + x * alpha``.  It depends on
the order and is not associative, so a part of a series seems to need the value before it.  But the rule
forgets: whatever value comes in, after some rows all possible values lie close together and mostly meet.

The rows are range-partitioned by (series, order), so a long series covers whole partitions and every
partition continues at most one series of the one before.  Each part is folded with bounds: the least and
the largest value that any incoming value can lead to.

* They meet: the value at the end of the part does not depend on what came before.  The part is independent.
* They stay a few floats apart (a constant series has several fixed points): the part is folded once more
  for each float between the bounds its predecessor leaves, which gives a small table in -> out.
* They stay far apart (few rows, or resets that some incoming values meet and others do not): the part
  waits for its predecessor and is folded from its value.

The driver walks the parts, one short record each, and then all parts are folded at once from their true
starting values.  The result is bit for bit that of the sequential fold.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_path

#: A part is folded once for each float between its bounds if there are at most so many.
MOST_CANDIDATES = 64


def fold(values: list[float], old: float, alpha: float, reset: float, out: list | None = None) -> float:
    """The rule over ``values`` from ``old``; a missing value (NaN) keeps the smoothed one."""
    keep = 1.0 - alpha
    for v in values:
        if v == v:
            old = v if abs(v - old) > reset else old * keep + v * alpha
        if out is not None:
            out.append(old)
    return old


def fold_bounds(values: list[float], lo: float, hi: float, alpha: float, reset: float) -> tuple[float, float]:
    """Bounds of the value after ``values`` for every start in [lo, hi].

    Starts within ``reset`` of x are moved towards it by a map that keeps their order (also when rounded), all
    others become x.  So the image lies between the images of the outermost starts that are kept, and x
    if any start is not."""
    keep = 1.0 - alpha
    for i, v in enumerate(values):
        if v != v:
            continue
        if lo == hi:
            lo = hi = fold(values[i:], lo, alpha, reset)
            break
        below, above = abs(v - lo) > reset, abs(v - hi) > reset
        if not below and not above:
            lo, hi = lo * keep + v * alpha, hi * keep + v * alpha
            continue
        if (below and above and (hi < v or lo > v)) or not math.isfinite(v):
            lo = hi = v  # every start is out of reach
            continue
        # the outermost starts that can be in reach: beyond the ends by more than a difference is rounded
        slack = 4 * (math.ulp(v) + math.ulp(reset))
        first = lo if not below else v - reset - slack
        last = hi if not above else v + reset + slack
        a, b = first * keep + v * alpha, last * keep + v * alpha
        lo, hi = min(a, v), max(b, v)
    return lo, hi


def _rank(v: float) -> int:
    """Place of a float among all floats."""
    n = struct.unpack("<q", struct.pack("<d", v))[0]
    return n if n >= 0 else -(n & 0x7FFFFFFFFFFFFFFF)


def floats_between(lo: float, hi: float, most: int) -> list[float] | None:
    """All floats in [lo, hi], None if there are more than ``most``."""
    if not (math.isfinite(lo) and math.isfinite(hi)) or _rank(hi) - _rank(lo) >= most:
        return None
    out = [lo]
    while out[-1] < hi:
        out.append(math.nextafter(out[-1], math.inf))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, str, bool, float]], list[float]]]:
    """(batch, runs, values): runs (from, to, series, does it go on from the batch before, its starting value)
    of a sorted part.  The last three columns are the series, the starting value and the value to smooth."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_columns
        names = batch.column(n - 3).to_numpy(zero_copy_only=False)
        values = batch.column(n - 1).to_numpy(zero_copy_only=False).astype(np.float64).tolist()
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        start = batch.column(n - 2)
        runs = [(a, b, names[a], names[a] == before, start[a].as_py()) for a, b in zip(cuts, cuts[1:])]
        before = names[-1]
        yield batch, runs, values


def _part_ends(alpha: float, reset: float):
    """One record per part: its first and last series, the value at its end if that series starts here, and the
    bounds of that value if the only series of the part goes on from the part before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        series, old, lo, hi = 0, 0.0, -math.inf, math.inf
        for batch, runs, values in _runs(batches):
            part = batch.column(0)[0].as_py()
            for a, b, name, goes_on, start in runs:
                if not goes_on:
                    first = name if first is None else first
                    last, series, old = name, series + 1, start
                old = fold(values[a:b], old, alpha, reset)
                if series == 1:
                    lo, hi = fold_bounds(values[a:b], lo, hi, alpha, reset)
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": last, "one": series == 1, "end": old, "lo": lo, "hi": hi}],
                                             schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("one", pa.bool_()),
                                                               ("end", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64())]))
    return run


def _part_tables(starts: dict[int, list[float]], alpha: float, reset: float):
    """(part, given, made): the value at the end of a part of one series for each start asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now = None, []
        for batch, _, values in _runs(batches):
            if part is None:
                part = batch.column(0)[0].as_py()
                now = list(starts[part])
            same = {v: None for v in now}
            for v in same:  # starts that have met go on together
                same[v] = fold(values, v, alpha, reset)
            now = [same[v] for v in now]
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(now), pa.int32()), pa.array(starts[part], pa.float64()),
                                              pa.array(now, pa.float64())], names=["part", "given", "made"])
    return run


def starting_values(rows: DataFrame, n: int, alpha: float, reset: float) -> dict[int, float]:
    """Value before each part that continues a series, of a table (part, seq, ..., series, start, x)."""
    ends = _in_parts(rows, n).mapInArrow(_part_ends(alpha, reset), "part int, first string, last string, one boolean, end double, lo double, hi double")
    parts = sorted(ends.collect(), key=lambda r: r["part"])  # one record per part
    known: dict[tuple[int, float], float] = {}  # (part, start) -> end, by folding
    while True:
        begin: dict[int, float] = {}
        ask: dict[int, list[float]] = {}
        value: float | None = None  # at the end of the part before; its bounds where it is not known yet
        lo = hi = 0.0
        for before, p in zip([None, *parts], parts):
            goes_on = before is not None and before["last"] == p["first"]
            if goes_on and value is not None:
                begin[p["part"]] = value
            if not (goes_on and p["one"]):
                value = lo = hi = p["end"]
                continue
            came, came_lo, came_hi = value, lo, hi
            value, lo, hi = (p["lo"] if p["lo"] == p["hi"] else None), p["lo"], p["hi"]
            if value is None:
                given = [came] if came is not None else floats_between(came_lo, came_hi, MOST_CANDIDATES)
                if given and any((p["part"], v) not in known for v in given):
                    ask[p["part"]] = given
                elif came is not None:
                    value = lo = hi = known[p["part"], came]
                elif given:
                    lo, hi = min(known[p["part"], v] for v in given), max(known[p["part"], v] for v in given)
        if not ask:
            return begin
        asked = _in_parts(rows.where(F.col("part").isin(list(ask))), n)
        for r in asked.mapInArrow(_part_tables(ask, alpha, reset), "part int, given double, made double").collect():
            known[r["part"], r["given"]] = r["made"]


def _in_parts(rows: DataFrame, n: int) -> DataFrame:
    """Each of the ``n`` parts in its own task, in order."""
    return rows.repartitionById(n, "part").sortWithinPartitions("part", "seq")


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.3, reset: float = 50_000.0,
        start: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(keys, order, value, ema) per row: exponential smoothing with reset per series.

    A series starts from 0, or from ``start`` (keys and ``ema``: the value it had reached).  ``order`` should be a total
    order within a series (nulls come first).  A null or NaN value keeps the smoothed one.  ``parts`` sets the number
    of parts (default: the shuffle partitions)."""
    spark = df.sparkSession
    cols = list(dict.fromkeys([*keys, *order, value]))
    series = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).alias("_series")
    rows = df.select(*cols, series)
    if start is None:
        rows = rows.withColumn("_start", F.lit(0.0))
    else:
        given = start.select(series, F.col("ema").cast("double").alias("_start"))
        rows = rows.join(given, "_series", "left").withColumn("_start", F.coalesce("_start", F.lit(0.0)))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["_series", *[F.col(c).asc_nulls_first() for c in order]]
    x = F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("_x")
    spread = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).select(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), *cols, "_series", "_start", x)
    # the parts are written once: sampled range bounds may differ when a lost task is run again
    path = checkpoint_path(spark, "smoothing", uuid.uuid4().hex)
    spread.write.parquet(path)
    stored = spark.read.schema(spread.schema).parquet(path)
    begin = starting_values(stored.select("part", "seq", "_series", "_start", "_x"), n, alpha, reset)
    schema = T.StructType([*[spread.schema[c] for c in cols], T.StructField("ema", T.DoubleType())])

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, part = 0.0, None
        for batch, runs, values in _runs(batches):
            out: list[float] = []
            for a, b, _, goes_on, first in runs:
                if not goes_on:
                    old = begin.get(batch.column(0)[0].as_py(), first) if part is None else first
                part = True
                old = fold(values[a:b], old, alpha, reset, out)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:-3], pa.array(out, pa.float64())], names=[*cols, "ema"])

    return _in_parts(stored, n).mapInArrow(smooth, schema)
