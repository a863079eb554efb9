"""Exact k-th row selection in a composite sort order without a global sort.

Used by ``risk_concentration`` (top 1 % of rows by score) and
``ordered_split`` (last 20 % of rows by time).  A ``limit(k)`` after an
``orderBy`` funnels k rows into one task, and a global window puts every row
in one partition; neither survives k = 1 % of a 100 TB table.

Instead the boundary row is found by narrowing a band of candidate values of
the leading sort column: ``percentile_approx`` gives bounds whose rank error is
at most n/accuracy, and one aggregate counts the rows below and inside the
band (≈ 4n/accuracy rows).  Each round is two distributed aggregates and
shrinks the band by about accuracy/4; only a few scalars reach the driver.
Once the band holds at most ``SMALL_BAND`` rows, its rows (the sort columns
only) are collected -- a bounded collect -- and the key is finished exactly on
the driver.  When one value of the leading column is shared by more rows than
that, the band cannot shrink; the search then fixes that value and goes on
with the next sort column among the rows holding it.  Rows equal in every sort
column are interchangeable for the order: the result says how many of them
belong below the cut.  Nulls sort first and NaN last in every column, as in
Spark's own comparison of structs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
SMALL_BAND = 50_000  # rows; a band this small is collected and finished on the driver


@dataclass
class Cut:
    """Boundary of the first ``k`` rows in ascending order of ``cols``.

    The first k rows are: every row whose key is lexicographically below
    ``key``, plus ``take`` of the rows whose key equals ``key``.
    """
    key: tuple
    take: int
    n_at: int | None = None   # rows equal to ``key`` (when the search saw them all)


def kth_cut(df: DataFrame, cols: Sequence[str], k: int, accuracy: int = ACCURACY,
            n: int | None = None) -> Cut | None:
    """Exact cut after the first ``k`` rows of ``df`` ordered ascending by ``cols``.

    ``cols`` must be numeric columns (negate a column for descending order;
    its nulls still sort first).  ``n`` is the row count when the caller knows
    it.  Returns None when ``k <= 0``.
    """
    if k <= 0:
        return None
    cols = list(cols)
    keys = df.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)  # narrow key columns, read by each round
    try:
        return _search(keys, cols, k, accuracy, n)
    finally:
        keys.unpersist(blocking=True)


def _finish_on_driver(band: DataFrame, cols: list[str], i: int, prefix: list, remaining: int) -> Cut:
    rows = sorted((tuple(r) for r in band.select(*cols[i:]).collect()), key=_order)
    if remaining > len(rows):
        raise ValueError("rank beyond the rows of the band")
    key = rows[remaining - 1]
    at = _order(key)
    below = sum(1 for r in rows if _order(r) < at)
    return Cut(key=tuple(prefix) + key, take=remaining - below, n_at=sum(1 for r in rows if _order(r) == at))


def _order(row: tuple) -> tuple:
    """Nulls first, NaN last."""
    return tuple((0, 0) if v is None else (2, 0) if isinstance(v, float) and math.isnan(v) else (1, v) for v in row)


def _search(keys: DataFrame, cols: list[str], k: int, accuracy: int, n: int | None) -> Cut:
    prefix: list = []        # fixed values of the leading columns
    band = keys              # candidate rows: prefix fixed, column i inside the band
    n_band = n               # rows in ``band`` when known
    remaining = k            # rank wanted inside ``band``
    i = 0
    floats = {f for f, t in keys.dtypes if t in ("double", "float")}
    while True:
        c = cols[i]
        if n_band is not None and n_band <= SMALL_BAND:
            return _finish_on_driver(band, cols, i, prefix, remaining)
        real = F.col(c).isNotNull() & ~F.isnan(c) if c in floats else F.col(c).isNotNull()
        v = F.when(real, F.col(c))
        aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("null"), F.count(v).alias("real"),
                F.min(v).alias("lo"), F.max(v).alias("hi")]
        q = None
        if n_band is not None:
            err = 2.0 * n_band / accuracy
            q = [max(0.0, (remaining - err) / n_band), min(1.0, (remaining + err) / n_band)]
            aggs.append(F.percentile_approx(v, q, accuracy).alias("q"))
        st = band.agg(*aggs).first()
        n_band, lo, hi, n_null, n_real = st["n"], st["lo"], st["hi"], st["null"], st["real"]
        if n_band == 0 or remaining > n_band:
            raise ValueError("rank beyond the rows of the band")
        if n_band <= SMALL_BAND:
            continue
        if remaining <= n_null or remaining > n_null + n_real:
            # the row holds null or NaN here: fix that and order by the next column
            null = remaining <= n_null
            prefix.append(None if null else math.nan)
            remaining -= 0 if null else n_null + n_real
            n_band = n_null if null else n_band - n_null - n_real
            if i == len(cols) - 1:
                return Cut(key=tuple(prefix), take=remaining, n_at=n_band)
            band = band.where(F.col(c).isNull() if null else F.isnan(c))
            i += 1
            continue
        if n_real < n_band:
            remaining -= n_null
            band, n_band = band.where(real), n_real
            continue
        if lo == hi:
            # one value holds the whole band: fix it and order by the next column
            prefix.append(lo)
            if i == len(cols) - 1:
                return Cut(key=tuple(prefix), take=remaining, n_at=n_band)
            band = band.where(F.col(c) == F.lit(lo))
            i += 1
            continue
        if q is None:
            continue  # n was unknown: now it is, compute the percentiles
        lo_v, hi_v = st["q"]
        lo_v = lo if q[0] == 0.0 else lo_v
        hi_v = hi if q[1] == 1.0 else hi_v
        cnt = band.agg(F.count(F.when(F.col(c) < F.lit(lo_v), 1)).alias("below"),
                       F.count(F.when((F.col(c) >= F.lit(lo_v)) & (F.col(c) <= F.lit(hi_v)), 1)).alias("inside")).first()
        below, inside = cnt["below"], cnt["inside"]
        if below < remaining <= below + inside and inside < n_band:
            remaining -= below
            band = band.where((F.col(c) >= F.lit(lo_v)) & (F.col(c) <= F.lit(hi_v)))
            n_band = inside
            continue
        # the sketch did not narrow the band (bound missed, or a heavy value spans it):
        # split the value range in halves instead
        mid = lo + (hi - lo) / 2 if isinstance(lo, float) else lo + (hi - lo) // 2
        if not lo <= mid < hi:  # an infinite end
            mid = lo
        left = band.where(F.col(c) <= F.lit(mid)).count()
        if left >= remaining:
            band, n_band = band.where(F.col(c) <= F.lit(mid)), left
        else:
            remaining -= left
            band, n_band = band.where(F.col(c) > F.lit(mid)), n_band - left


def key_struct(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])


def _key_literal(df: DataFrame, cols: Sequence[str], key: Sequence) -> Column:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return F.struct(*[F.lit(v).cast(types[c]).alias(f"k{i}") for i, (c, v) in enumerate(zip(cols, key))])


def below_cut(df: DataFrame, cols: Sequence[str], cut: Cut) -> Column:
    """Rows strictly below the cut's key: one struct comparison (lexicographic),
    which the optimizer keeps as a single predicate."""
    return key_struct(df, cols) < _key_literal(df, cols, cut.key)


def upto_cut(df: DataFrame, cols: Sequence[str], cut: Cut) -> Column:
    """Rows at or below the cut's key (one struct comparison)."""
    return key_struct(df, cols) <= _key_literal(df, cols, cut.key)


def at_cut(df: DataFrame, cols: Sequence[str], cut: Cut) -> Column:
    return key_struct(df, cols) == _key_literal(df, cols, cut.key)
