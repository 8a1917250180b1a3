"""Whole-table orders without one task that sees all rows.

A table is dealt into ranges of its order, which follow from the data: a key, or
even one moment of it, that holds many rows is spread over several ranges. What
runs along the order is done inside each range; what crosses from one range to
the next is carried over in a summary of one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize

RANGE = "_range"


def into_ranges(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` with its range number, stored; ranges follow ``order``, which should tell all rows apart."""
    return materialize(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), label)


def _in_order(summary: DataFrame, *values: str) -> DataFrame:
    """All ranges as one row, in their order: as many entries as there are partitions."""
    return summary.agg(F.sort_array(F.collect_list(F.struct(RANGE, *values))).alias("_all"))


def carried(summary: DataFrame, value: str) -> DataFrame:
    """(_range, before): ``value`` of the range before, null for the first."""
    paired = F.transform("_all", lambda x, i: F.struct(
        x[RANGE].alias(RANGE), F.when(i > 0, F.get("_all", i - 1)[value]).alias("before")))
    return _in_order(summary, value).select(F.inline(paired))


def running(summary: DataFrame, value: str) -> DataFrame:
    """(_range, before): the sum of ``value`` over all ranges before."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast(f"array<struct<{RANGE}:int,before:bigint>>").alias("out"))
    folded = F.aggregate("_all", start, lambda s, x: F.struct(
        (s["sum"] + x[value]).alias("sum"), F.concat(s["out"], F.array(F.struct(x[RANGE].alias(RANGE), s["sum"].alias("before")))).alias("out")),
        lambda s: s["out"])
    return _in_order(summary, value).select(F.inline(folded))
