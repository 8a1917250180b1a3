"""Declared datasets: columns, named metrics, filters. Metrics are SQL aggregate text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.plans.periods import time_range_filter

LG_K = 12  # sketches of 4,096 buckets: 1.6 % standard error of a distinct count

@dataclass(frozen=True)
class Metric:
    expression: str
    uses: tuple[str, ...] = ()
    kind: str = "expression"

    def column(self, alias: str) -> Column:
        return F.expr(self.expression).alias(alias)

    def approximated(self, lg_k: int) -> Metric:
        """A distinct count from a sketch, whose size does not grow with the values; any other metric stays exact."""
        if self.kind != "count_distinct":
            return self
        return replace(self, expression=f"hll_sketch_estimate(hll_sketch_agg({self.uses[0]}, {lg_k}))")


@dataclass(frozen=True)
class Field:
    type: str
    is_dttm: bool = False
    filterable: bool = True
    groupby: bool = True


@dataclass(frozen=True)
class Dataset:
    """``source`` takes the wanted column names, so unused dimension joins are never planned."""

    source: Callable[[str], DataFrame]
    columns: dict[str, Field]
    metrics: dict[str, Metric] = field(default_factory=dict)

    def metric(self, name: str, approx: bool = False) -> Metric:
        if name not in self.metrics:
            raise KeyError(f"unknown metric {name!r}")
        return self.metrics[name].approximated(LG_K) if approx else self.metrics[name]

    def approximated(self, lg_k: int = LG_K) -> Dataset:
        """The same dataset with approximate distinct counts, for any chart."""
        return replace(self, metrics={name: m.approximated(lg_k) for name, m in self.metrics.items()})

    def load(self, names: list[str]) -> DataFrame:
        wanted = [n for n in self.columns if n in names]
        unknown = set(names) - set(wanted)
        if unknown:
            raise KeyError(f"unknown columns {sorted(unknown)}")
        return self.source(" ".join(wanted))


@dataclass(frozen=True)
class Filter:
    subject: str
    comparator: object = None
    operator: str = "=="


_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "IN": lambda c, v: c.isin(list(v)),
    "NOT IN": lambda c, v: ~c.isin(list(v)), "LIKE": lambda c, v: c.like(v),
    "IS NULL": lambda c, v: c.isNull(), "IS NOT NULL": lambda c, v: c.isNotNull(),
}


def adhoc_filters(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """Simple WHERE clauses, all of which must hold."""
    for f in filters:
        if f.operator not in _COMPARE:
            raise ValueError(f"unknown filter operator {f.operator!r}")
        df = df.filter(_COMPARE[f.operator](F.col(f.subject), f.comparator))
    return df


def filtered(df: DataFrame, filters: list[Filter] = (), time_range: str | None = None, time: str | None = None,
             as_of: dt.date | None = None) -> DataFrame:
    if time_range:
        df = time_range_filter(df, time, time_range, as_of)
    return adhoc_filters(df, list(filters))


def related_column(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, columns: list[str],
                   how: str = "left") -> DataFrame:
    """Bring dimension columns to the fact rows; the planner picks the join from measured sizes."""
    side = dim.select(F.col(dim_key).alias("_k"), *columns)
    return fact.join(side, fact[fact_key] == side["_k"], how).drop("_k")


def retarget(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rename columns through a mapping document; names outside it stay."""
    return df.withColumnsRenamed(columns)


def retarget_names(names: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Rename stored metric, table or schema names by literal lookup."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return names.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


# The sales dataset's declared metrics.
SALES_METRICS = {
    "total_revenue": Metric("SUM(revenue)", ("revenue",), "sum"),
    "total_profit": Metric("SUM(profit)", ("profit",), "sum"),
    "total_quantity": Metric("SUM(quantity)", ("quantity",), "sum"),
    "order_count": Metric("COUNT(*)", (), "count"),
    "avg_order_value": Metric("AVG(revenue)", ("revenue",), "avg"),
    "unique_customers": Metric("COUNT(DISTINCT customer_id)", ("customer_id",), "count_distinct"),
    "profit_margin": Metric("COALESCE(SUM(profit) / NULLIF(SUM(revenue), 0), 0)", ("profit", "revenue")),
    "building_revenue": Metric("SUM(revenue) FILTER (WHERE segment = 'BUILDING')", ("revenue", "segment")),
}
SALES_COLUMNS = {
    "order_id": Field("BIGINT"), "order_date": Field("TIMESTAMP", is_dttm=True), "customer_id": Field("BIGINT"),
    "segment": Field("VARCHAR"), "nation": Field("VARCHAR"), "region": Field("VARCHAR"), "brand": Field("VARCHAR"),
    "category": Field("VARCHAR"), "product_name": Field("VARCHAR"), "channel": Field("VARCHAR"),
    "quantity": Field("NUMERIC", groupby=False), "revenue": Field("NUMERIC", groupby=False),
    "profit": Field("NUMERIC", groupby=False),
}


def sales_dataset(tables) -> Dataset:
    return Dataset(lambda names: tables.view("fact_sales", columns=names), SALES_COLUMNS, SALES_METRICS)
