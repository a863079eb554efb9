"""Registered queries: stand-in input -> library operator, with a DuckDB twin.

Each entry is ``name -> (build(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
The oracle SQL runs in DuckDB over the same parquet tables (registered as
views under their table names) and must return the same columns.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures as fx

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def with_tx(body: str) -> str:
    return f"with tx as (\n{fx.tx_sql()}\n)\n{body}"


def queries() -> dict[str, Builder]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load_all() -> None:
    from . import q_risk, q_features, q_series, q_samples, q_text, q_sources, q_ml, q_pressure, q_streams  # noqa: F401
