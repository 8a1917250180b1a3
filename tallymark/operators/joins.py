"""Joins that keep rows whose key is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key, as grouping does."""
    values = [x for x in right.columns if x not in keys]
    side = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *values)
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(side[f"_right_{k}"]) for k in keys))
    return left.join(side, same, how).drop(*[f"_right_{k}" for k in keys])
