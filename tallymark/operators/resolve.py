"""Mapping visuals to chart kinds and picking the first renderer type that is available."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.scalars import unfold
from tallymark.plans.chart_catalog import KINDS, VISUALS

c = F.col


def map_visuals(rows: DataFrame, column: str = "visual") -> DataFrame:
    """Chart kind of an external visual; null when there is none."""
    table = F.create_map(*[F.lit(x) for pair in VISUALS.items() for x in pair])
    return rows.withColumn("kind", F.try_element_at(table, c(column)))


# (kind, stage, position, candidate): preferred types are stage 0, fallbacks stage 1
CANDIDATES = tuple((kind, stage, i, name) for kind, spec in KINDS.items()
                   for stage, names in enumerate(spec[2:]) for i, name in enumerate(names))


# Fixed value: the type of a kind that the catalogue does not know.
UNKNOWN_KIND = "line"


def resolve_candidates(requests: DataFrame, available: DataFrame, scope: str, options=CANDIDATES) -> DataFrame:
    """One type per (scope, kind): preferred before fallback, exact before fuzzy, then order.

    A fuzzy match reads '_' and '-' as "anything between", ignoring case. When
    nothing fits, the first fallback is taken, and ``line`` for an unknown kind. The candidates are a fixed list,
    so each available type is tested against them where it is read, and only
    its matches go on to a plain minimum: no pairing of rows.
    """
    viz = c("viz_type")

    def match(kind: str, stage: int, position: int, candidate: str):
        fuzzy = "(?i)" + re.sub(r"[_\-]+", ".*", re.escape(candidate).replace("\\-", "-"))
        hit = F.struct(F.lit(kind).alias("kind"), F.lit(stage).alias("stage"), F.when(viz == candidate, 0).otherwise(1).alias("fuzzy"),
                       F.lit(position).alias("position"))
        return F.when((viz == candidate) | viz.rlike(fuzzy), hit)

    hits = (available.select(scope, "viz_type").distinct()
            .transform(lambda df: unfold(df, [scope, "viz_type"], F.array_compact(F.array(*[match(*o) for o in options])), "m"))
            .groupBy(scope, c("m.kind").alias("kind"))
            .agg(F.min(F.struct("m.stage", "m.fuzzy", "m.position", "viz_type")).alias("best")))
    first = F.create_map(*[F.lit(x) for kind, stage, position, name in options if (stage, position) == (1, 0) for x in (kind, name)])
    return (requests.select(scope, "kind").distinct().join(hits, [scope, "kind"], "left")
            .select(scope, "kind", F.coalesce("best.viz_type", F.try_element_at(first, c("kind")), F.lit(UNKNOWN_KIND)).alias("viz_type"),
                    F.when(c("best").isNull(), "default").when(c("best.fuzzy") == 0, "exact").otherwise("fuzzy").alias("how")))


def viz_type_counts(available: DataFrame) -> DataFrame:
    """Distinct types, split by the 'echarts' prefix."""
    modern = c("viz_type").startswith("echarts")
    return available.select("viz_type").distinct().agg(
        F.count("*").alias("count"), F.count_if(modern).alias("echarts_count"), F.count_if(~modern).alias("classic_count"))
