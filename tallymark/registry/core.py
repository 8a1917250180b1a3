"""Binds a query function, its output types and its check SQL under one key.

The output types are given once (``"name:s total:d n:l"``) and cast on both
sides, because the two engines differ in their default result types.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.registry.check_views import CHECK_VIEWS
from tallymark.session import apply_settings
from tallymark.sources.tables import Tables

SPARK_TYPES = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
CHECK_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}
MODULES = ("finance", "clearance", "billing", "portfolio", "semantic", "charts", "windows", "quality", "catalog",
           "pages", "commands", "textscan", "functions", "sources", "streaming")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_checks: dict[str, str] = {}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]


def query(key: str, spec: str, sql: str | None = None, views: str = "", ctes: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``views``/``ctes`` prefix the check SQL."""
    fields = _fields(spec)

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            df = fn(Tables(spark, sf_dir))
            return df.select(*[F.col(n).cast(SPARK_TYPES[t]).alias(n) for n, t in fields])

        if key in _queries:
            raise ValueError(f"query {key} is registered twice")
        _queries[key] = run
        if sql is not None:
            parts = [f"{v} AS ({CHECK_VIEWS[v]})" for v in views.split()]
            if ctes:
                parts.append(ctes)
            head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
            cast = ", ".join(f'CAST("{n}" AS {CHECK_TYPES[t]}) AS "{n}"' for n, t in fields)
            _checks[key] = f"{head}SELECT {cast} FROM ({sql}) AS checked"
        return fn

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tallymark.registry.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_checks)


def half_up(num: str, den: str, places: int) -> str:
    """Check SQL: num/den rounded half away from zero, from whole numbers only.

    Gives a DOUBLE that is the nearest one to the rounded decimal.
    """
    return (f"((CASE WHEN (({num}) < 0) <> (({den}) < 0) THEN -1 ELSE 1 END"
            f" * ((2 * abs(CAST({num} AS HUGEINT)) * {10 ** places} + abs(CAST({den} AS HUGEINT)))"
            f" // (2 * abs(CAST({den} AS HUGEINT))))) / CAST({10 ** places} AS DOUBLE))")


def cents(col: str, places: int = 2) -> str:
    """Check SQL: a decimal as a whole number of its smallest unit."""
    return f"CAST({col} * {10 ** places} AS HUGEINT)"
