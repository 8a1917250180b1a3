"""Small Column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def js_or(value: Column, default, blank=None) -> Column:
    """``value || default`` as JavaScript reads it: null, 0 and '' all take the default."""
    blank = ("" if isinstance(default, str) else 0) if blank is None else blank
    return F.when(value.isNull() | (value == F.lit(blank)), F.lit(default)).otherwise(value)


def ratio_or(num: Column, den: Column, otherwise, decimal_type: str, scale: int = 1) -> Column:
    """``num / den * scale`` when den > 0, else ``otherwise``; cast to ``decimal_type``."""
    value = num / F.when(den > 0, den)
    if scale != 1:
        value = num * scale / F.when(den > 0, den)
    return F.when(den > 0, value).otherwise(otherwise).cast(decimal_type)


def unfold(df: DataFrame, columns: list, array: Column, name: str) -> DataFrame:
    """One row per array element beside ``columns``; empty arrays give none.

    Spark guards a plain explode with a filter on the array's size, which works
    out a costly array expression again for every mention. The outer form has no
    such guard, and its empty rows are dropped afterwards.
    """
    return df.select(*columns, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def mean(col: Column) -> Column:
    """Average of an exact number as one double division (same bits on every plan)."""
    return F.sum(col).cast("double") / F.count(col).cast("double")


def slug(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit(" "), F.lit("-"))


def title_from_slug(col: Column) -> Column:
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def strip_quotes(col: Column) -> Column:
    """Strip white space of any kind, then drop one pair of matching quotes."""
    bare = F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.regexp_replace(bare, r"""^(?:"([\s\S]*)"|'([\s\S]*)')$""", "$1$2")


def parse_float_prefix(col: Column) -> Column:
    """``parseFloat``: the numeric prefix after leading blanks, else null."""
    return F.regexp_extract(col, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def ellipsis(col: Column, limit: int = 240) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("…"))).otherwise(col)


# ISO-8601 duration grains and the truncation unit of each.
TIME_GRAINS = {"PT1S": "second", "PT1M": "minute", "PT1H": "hour", "P1D": "day", "P1W": "week",
               "P1M": "month", "P3M": "quarter", "P1Y": "year"}


def time_bucket(col: Column, grain: str = "P1D") -> Column:
    """Start of the grain's period; a date for grains of a day or more."""
    if grain not in TIME_GRAINS:
        raise ValueError(f"unknown time grain {grain!r}")
    unit = TIME_GRAINS[grain]
    if unit in ("second", "minute", "hour"):
        return F.date_trunc(unit, col)
    return F.date_trunc(unit, col).cast("date")


def dax_to_sql(col: Column) -> Column:
    """Rewrite the common measure functions, then ``Table[Column]`` to the bare column."""
    out = F.regexp_replace(col, r"\bDISTINCTCOUNT\(", "COUNT(DISTINCT ")
    out = F.regexp_replace(out, r"\bAVERAGE\(", "AVG(")
    return F.regexp_replace(out, r"\b\w+\[(\w+)\]", "$1")


def dax_to_sql_literal(col: Column) -> Column:
    """The four plain replacements in their published order.

    ``COUNT(`` and ``SUM(`` map to themselves, and brackets stay as they are.
    """
    for old, new in (("AVERAGE(", "AVG("), ("DISTINCTCOUNT(", "COUNT(DISTINCT ")):
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def canonical_url(col: Column) -> Column:
    """Lower-case scheme and host, no query, no fragment, no trailing slash."""
    head = F.lower(F.regexp_extract(col, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(head, F.regexp_replace(path, "/+$", ""))
