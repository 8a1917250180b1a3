"""Named time ranges as literal bounds typed like the column, so they reach the scan."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _month_start(day: dt.date, months: int = 0) -> dt.date:
    index = day.year * 12 + day.month - 1 + months
    return dt.date(index // 12, index % 12 + 1, 1)


def _shift_months(day: dt.date, months: int) -> dt.date:
    first = _month_start(day, months)
    last = (_month_start(first, 1) - dt.timedelta(days=1)).day
    return first.replace(day=min(day.day, last))


def period_bounds(period: str, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Half-open bounds of a named reporting period."""
    month = _month_start(as_of)
    quarter = _month_start(as_of, -((as_of.month - 1) % 3))
    bounds = {
        "this_month": (month, _month_start(as_of, 1)),
        "last_month": (_month_start(as_of, -1), month),
        "this_quarter": (quarter, _month_start(quarter, 3)),
        "ytd": (dt.date(as_of.year, 1, 1), as_of + dt.timedelta(days=1)),
    }
    if period not in bounds:
        raise ValueError(f"unknown period {period!r}")
    return bounds[period]


def time_range_bounds(text: str, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """'Last 7 days', 'Last month', 'Last 2 years', ...: the half-open span that ends at ``as_of``."""
    match = re.fullmatch(r"last (?:(\d+) )?(day|week|month|quarter|year)s?", text.strip().lower())
    if not match:
        raise ValueError(f"unknown time range {text!r}")
    n, unit = int(match.group(1) or 1), match.group(2)
    if unit in ("day", "week"):
        return as_of - dt.timedelta(days=n * (7 if unit == "week" else 1)), as_of
    return _shift_months(as_of, -n * {"month": 1, "quarter": 3, "year": 12}[unit]), as_of


def between(df: DataFrame, column: str, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """start <= column < end; either bound may be missing."""
    kind = df.schema[column].dataType
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(F.col(column) < F.lit(end).cast(kind))
    return df


def time_range_filter(df: DataFrame, column: str, text: str, as_of: dt.date) -> DataFrame:
    return between(df, column, *time_range_bounds(text, as_of))
