"""Change feeds folded to tables: upsert, audit trail, event timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.ranges import RANGE, carried, into_ranges
from tallymark.sources.views import PERCENT

c = F.col


def upsert_latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key; the answer does not depend on arrival order.

    An aggregate rather than a row number: every map task keeps one row per key,
    so a key with most of the rows costs no more than any other.
    """
    values = [x for x in changes.columns if x not in keys]
    return (changes.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row"))
            .select(*keys, "_row.*").select(*changes.columns))


def budget_audit(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An audit row per change: the key's first is 'created', later ones 'updated'.

    The first position per key is an aggregate that is joined back, so no task
    has to order all changes of one key.
    """
    first = changes.groupBy(*keys).agg(F.min(order).alias("_first"))
    return budget_audit_rows(changes.join(first, keys), order, c(order) == c("_first"))


def budget_audit_rows(changes: DataFrame, order: str, is_first: Column) -> DataFrame:
    gap = c("actual_amount") - c("planned_amount")
    pct = F.when(c("planned_amount") > 0, gap * 100 / F.when(c("planned_amount") > 0, c("planned_amount"))).otherwise(0)
    doc = F.struct(c("planned_amount").alias("planned"), c("actual_amount").alias("actual"),
                   pct.cast(PERCENT).alias("variance_pct"))
    return changes.select(
        "company_id", F.lit("budget_sync").alias("workflow_type"), c("project_id").cast("string").alias("source_record_id"),
        c(order), F.when(is_first, "created").otherwise("updated").alias("action"),
        F.to_json(doc).alias("metadata"))


def timeline(events: DataFrame, keys: list[str], time: str, tie: str, kind: str) -> DataFrame:
    """Each event with its predecessor's kind and the microseconds since it.

    A plain lag would sort all events of a key in one task. Here the events are
    dealt into ranges by key, time and ``tie``, so that a hot key, or a hot moment
    of it, is spread; the lag runs inside each range, and its first event looks at
    the last one of the range before. Keys and times are declared NOT NULL.
    """
    order = [*keys, time, tie]
    ranged = into_ranges(events, [c(x) for x in order], "timeline")
    local = Window.partitionBy(RANGE, *keys).orderBy(time, tie)
    here = F.struct(c(time).alias("t"), c(kind).alias("k"))
    last = ranged.groupBy(RANGE).agg(F.max(F.struct(*order, kind)).alias("last"))
    same_key = reduce(lambda a, b: a & b, (c(f"before.{k}") == c(k) for k in keys))
    far = F.when(same_key, F.struct(c(f"before.{time}").alias("t"), c(f"before.{kind}").alias("k")))
    prev = F.coalesce(F.lag(here).over(local), far)
    return (ranged.join(carried(last, "last"), RANGE)
            .withColumn("_prev", prev)
            .withColumn("previous", c("_prev.k"))
            .withColumn("micros_since", F.unix_micros(time) - F.unix_micros("_prev.t"))
            .drop(RANGE, "before", "_prev"))
