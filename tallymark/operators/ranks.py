"""Ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.joins import join_null_safe
from tallymark.operators.ranges import RANGE, into_ranges, running

c = F.col


def global_rank(df: DataFrame, score: str, alias: str) -> DataFrame:
    """1 for the highest ``score``; equal scores share a rank and the next one skips; a null comes last.

    Rows are counted per score first, so a score that many rows share is one row.
    The scores are dealt into ranges; a rank is the rows of the ranges before, the
    rows of the own range before, and one.
    """
    falling = c(score).desc_nulls_last()
    scores = into_ranges(df.groupBy(score).agg(F.count("*").alias("_n")), [falling], "scores")
    before = running(scores.groupBy(RANGE).agg(F.sum("_n").alias("_n")), "_n")
    inside = Window.partitionBy(RANGE).orderBy(falling).rowsBetween(Window.unboundedPreceding, -1)
    placed = scores.join(before, RANGE).select(score, (c("before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1).alias(alias))
    return join_null_safe(df, placed, [score])
