"""Approximate distinct counts from sketches that are stored once and united for any chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.plans.semantic import LG_K, Dataset

SKETCH = "sketch"


def error_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Relative error that a united sketch of 2^lg_k buckets keeps, at so many standard deviations."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def distinct_sketches(dataset: Dataset, metric: str, time: str, dimensions: list[str], lg_k: int = LG_K) -> DataFrame:
    """(day, *dimensions, sketch): one sketch of the counted column per day and combination of dimensions."""
    m = dataset.metric(metric)
    if m.kind != "count_distinct":
        raise ValueError(f"{metric!r} is not a distinct count")
    df = dataset.load([time, *dimensions, *m.uses])
    return df.groupBy(F.col(time).cast("date").alias("day"), *dimensions).agg(F.hll_sketch_agg(m.uses[0], lg_k).alias(SKETCH))


def merged(sketches: DataFrame) -> DataFrame:
    """One sketch per day and combination again, after sketches of further rows were added.

    A union of sketches does not count a value twice, so late rows, and rows that
    were taken in before, may come in any order. This is a fold for a stored snapshot.
    """
    keys = [x for x in sketches.columns if x != SKETCH]
    return sketches.groupBy(*keys).agg(F.hll_union_agg(SKETCH).alias(SKETCH)).select(*sketches.columns)


def united(sketches: DataFrame, *keys) -> DataFrame:
    """Approximate distinct counts per ``keys``, columns or expressions over the stored ones. None: over everything."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(SKETCH)).alias("value"))
