"""A use case: one dataset, five charts, two native filters applied to every chart."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.scalars import time_bucket
from tallymark.plans.charts import chart
from tallymark.plans.semantic import Dataset, Filter, Metric, filtered
from tallymark.session import materialize


@dataclass(frozen=True)
class ChartSpec:
    kind: str
    bindings: dict
    row_limit: int | None = None


def _grouping(spec: ChartSpec) -> list[tuple[str, str | None]] | None:
    """(column, time grain or None) that the chart groups by; None if it is more than one plain grouping of one metric."""
    b, day = spec.bindings, "P1D"
    if not isinstance(b.get("metric"), str):
        return None
    if spec.kind in ("line", "area"):
        return [(b["time"], b.get("time_grain") or day)] + ([(b["group_by"], None)] if b.get("group_by") else [])
    if spec.kind == "kpi":
        return [(b["time"], day)] if b.get("time") else []
    names = {"bar": ["category"], "pie": ["category"], "donut": ["category"], "bar_stacked": ["category", "stack_by"],
             "heatmap": ["x", "y"], "choropleth": ["geo"], "funnel": ["category"], "kpi_total": []}
    return [(b[k], None) for k in names[spec.kind]] if spec.kind in names else None


@dataclass(frozen=True)
class Dashboard:
    dataset: Dataset
    columns: tuple[str, ...]
    charts: dict[str, ChartSpec]
    time_column: str
    select_column: str
    filters: list[Filter] = field(default_factory=list)

    def base(self, time_range: str | None = None, as_of: dt.date | None = None, selected: list | None = None) -> DataFrame:
        """The filtered rows every chart reads."""
        extra = [Filter(self.select_column, selected, "IN")] if selected else []
        return filtered(self.dataset.load(list(self.columns)), [*self.filters, *extra], time_range, self.time_column, as_of)

    def _shared(self) -> tuple[dict[str, list], list, list[str]]:
        groupings = {n: g for n, s in self.charts.items() if (g := _grouping(s)) is not None}
        keys = list(dict.fromkeys(k for g in groupings.values() for k in g))
        return groupings, keys, list(dict.fromkeys(self.charts[n].bindings["metric"] for n in groupings))

    def aggregated(self, base: DataFrame) -> DataFrame:
        """Every grouping of every chart in one pass over ``base``: (_set, _k0.., _m0..), told apart by the grouping id ``_set``."""
        groupings, keys, metrics = self._shared()
        name = {k: f"_k{i}" for i, k in enumerate(keys)}
        uses = list(dict.fromkeys(u for m in metrics for u in self.dataset.metric(m).uses))
        made = [(F.col(x) if grain is None else time_bucket(F.col(x), grain)).alias(name[x, grain]) for x, grain in keys]
        sets = list(dict.fromkeys(tuple(name[k] for k in g) for g in groupings.values()))
        rows = base.select(*made, *uses)
        values = [self.dataset.metric(m).column(f"_m{i}") for i, m in enumerate(metrics)]
        if not keys:
            return rows.agg(F.lit(0).alias("_set"), *values)
        return rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in name.values()]).agg(F.grouping_id().alias("_set"), *values)

    def build(self, base: DataFrame) -> dict[str, DataFrame]:
        """The data of each chart.

        Charts that are one grouping of one metric read a table of all groupings,
        which one pass over ``base`` makes and whose size is that of the charts. Any
        other chart passes over ``base`` itself.
        """
        groupings, keys, metrics = self._shared()
        stored = materialize(self.aggregated(base), "dashboard") if groupings else None
        out = {}
        for chart_name, s in self.charts.items():
            if chart_name not in groupings:
                out[chart_name] = chart(self.dataset, s.kind, base=base, row_limit=s.row_limit, **s.bindings)
                continue
            own = groupings[chart_name]
            number = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
            rows = stored.filter(F.col("_set") == number).select(
                *[F.col(f"_k{keys.index(k)}").alias(k[0]) for k in own], F.col(f"_m{metrics.index(s.bindings['metric'])}").alias("_value"))
            # a group is one row here, so its first value is the metric, and a bucket of time falls into itself
            done = replace(self.dataset, metrics={s.bindings["metric"]: Metric("FIRST(_value)")})
            out[chart_name] = chart(done, s.kind, base=rows, row_limit=s.row_limit, **s.bindings)
        return out


def retail_dashboard(dataset: Dataset) -> Dashboard:
    return Dashboard(
        dataset, ("order_date", "product_name", "category", "revenue"),
        {"revenue_trend": ChartSpec("line", {"metric": "total_revenue", "time": "order_date", "time_grain": "P1D"}),
         "top_products": ChartSpec("bar", {"metric": "total_revenue", "category": "product_name"}, 10),
         "top_categories": ChartSpec("bar", {"metric": "total_revenue", "category": "category"}, 5),
         "total_revenue_kpi": ChartSpec("kpi", {"metric": "total_revenue", "time": "order_date", "compare_lag": 7}),
         "order_count_kpi": ChartSpec("kpi", {"metric": "order_count", "time": "order_date", "compare_lag": 7})},
        "order_date", "category")
