"""One DataFrame per chart kind over a declared dataset.

``chart(dataset, kind, **bindings)`` checks the bindings, loads only the columns
they name, applies the filters and builds the aggregation of the kind.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.scalars import time_bucket
from tallymark.operators import series
from tallymark.operators.joins import join_null_safe
from tallymark.operators.quantiles import boxplot
from tallymark.operators.tree import tree_expand
from tallymark.plans.chart_catalog import check_bindings
from tallymark.plans.semantic import Dataset, Filter, Metric, filtered
from tallymark.session import materialize

c = F.col
TOP_N = 10


class _Request:
    """What a chart builder works on: filtered rows plus resolved bindings."""

    def __init__(self, df: DataFrame, dataset: Dataset, bindings: dict, row_limit: int | None):
        self.df, self.dataset, self.b, self.row_limit = df, dataset, bindings, row_limit

    def metric(self, alias: str = "value"):
        return self.dataset.metric(self.b["metric"]).column(alias)

    def top(self, df: DataFrame, value: str, *ties: str) -> DataFrame:
        return self.cut(df.orderBy(c(value).desc(), *ties))

    def cut(self, df: DataFrame) -> DataFrame:
        """All rows, unless the caller asked for a number of them."""
        return df if self.row_limit is None else df.limit(self.row_limit)


def _series_keys(r: _Request):
    bucket = time_bucket(c(r.b["time"]), r.b.get("time_grain") or "P1D").alias("time")
    return [bucket] + ([c(r.b["group_by"])] if r.b.get("group_by") else [])


def _line(r: _Request) -> DataFrame:
    return r.df.groupBy(*_series_keys(r)).agg(r.metric())


def _area(r: _Request) -> DataFrame:
    df = _line(r)
    if r.b.get("stacked"):
        # after aggregation one time bucket holds one row per series
        w = Window.partitionBy("time").orderBy(r.b["group_by"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn("stack_top", F.sum("value").over(w))
    return df


def _bars(r: _Request) -> DataFrame:
    return r.df.groupBy(r.b["category"]).agg(r.metric())


def _bar(r: _Request) -> DataFrame:
    """Bars by size; ``orientation`` travels with them, ``stacked`` asks for the base line of each bar."""
    bars = r.top(_bars(r), "value", r.b["category"])
    if r.b.get("orientation"):
        bars = bars.withColumn("orientation", F.lit(r.b["orientation"]))
    return bars.withColumn("stack_base", F.lit(0).cast(bars.schema["value"].dataType)) if r.b.get("stacked") else bars


def _bar_stacked(r: _Request) -> DataFrame:
    cat, part = r.b["category"], r.b["stack_by"]
    w = Window.partitionBy(cat).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = r.df.groupBy(cat, part).agg(r.metric()).withColumn("stack_top", F.sum("value").over(w))
    return stacked.withColumn("stack_base", c("stack_top") - c("value"))


def _pie(r: _Request) -> DataFrame:
    return series.share_of_total(r.df, [r.b["category"]], r.dataset.metric(r.b["metric"]).column("value"))


def _scatter(r: _Request) -> DataFrame:
    """Every point as it is."""
    return r.cut(r.df.select(*[r.b[k] for k in ("x", "y", "category", "size") if r.b.get(k)]))


def _bubble(r: _Request) -> DataFrame:
    keys = [r.b["category"]] if r.b.get("category") else []
    return r.df.groupBy(*keys).agg(F.avg(r.b["x"]).alias("x"), F.avg(r.b["y"]).alias("y"), F.sum(r.b["size"]).alias("size"))


def _heatmap(r: _Request) -> DataFrame:
    return r.df.groupBy(r.b["x"], r.b["y"]).agg(r.metric())


def _calendar_heatmap(r: _Request) -> DataFrame:
    return (r.df.groupBy(c(r.b["date"]).cast("date").alias("day")).agg(r.metric())
            .withColumns({"year": F.year("day"), "week": F.weekofyear("day"), "weekday": F.dayofweek("day")}))


def _funnel(r: _Request) -> DataFrame:
    """Stages by size, each with its share of the stage before.

    The stages are dealt into ranges and stored; the lag runs inside each range,
    and only the last stage of every range goes through one window.
    """
    key = r.b["category"]
    order = [c("value").desc(), c(key)]
    ranged = materialize(r.cut(_bars(r).orderBy(*order)).repartitionByRange(*order)
                         .withColumn("_range", F.spark_partition_id()), "stages")
    ends = ranged.groupBy("_range").agg(F.min("value").alias("_end"))  # the last of a falling order
    ends = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_last"))
    inside = F.lag("value").over(Window.partitionBy("_range").orderBy(*order))
    before = F.coalesce(inside, "_last")
    return (ranged.join(ends, "_range").withColumn("_before", before)
            .withColumn("step_rate", c("value").cast("double") / F.when(c("_before") != 0, c("_before")).cast("double"))
            .drop("_range", "_last", "_before"))


def _gauge(r: _Request) -> DataFrame:
    low, high = (float(r.b.get(k, v)) for k, v in (("min", 0), ("max", 100)))
    if low >= high:
        raise ValueError(f"a gauge needs min < max, not {low} and {high}")
    part = (c("value").cast("double") - low) / (high - low)
    return r.df.agg(r.metric()).withColumn("fraction", F.least(F.lit(1.0), F.greatest(F.lit(0.0), part)))


def _kpi(r: _Request) -> DataFrame:
    if not r.b.get("time"):
        return _kpi_total(r)
    return series.kpi_compare_lag(r.df, c(r.b["time"]).cast("date"), r.metric(), int(r.b.get("compare_lag", 7)))


def _kpi_total(r: _Request) -> DataFrame:
    return r.df.agg(r.metric())


def _levels(r: _Request) -> list[str]:
    return [*(r.b.get("hierarchy") or []), r.b["category"]]


def _treemap(r: _Request) -> DataFrame:
    return r.df.rollup(*_levels(r)).agg(F.grouping_id().alias("level_id"), r.metric())


def _sunburst(r: _Request) -> DataFrame:
    levels = _levels(r)
    # a rolled-up level is recognised by its grouping bit, not by a null value
    shown = [F.when(c(f"_g{i}") == 0, F.coalesce(c(x).cast("string"), F.lit(""))) for i, x in enumerate(levels)]
    df = r.df.rollup(*levels).agg(*[F.grouping(x).alias(f"_g{i}") for i, x in enumerate(levels)], r.metric())
    depth = sum((F.lit(1) - c(f"_g{i}").cast("int") for i in range(len(levels))), F.lit(0))
    return df.select(F.concat_ws(" / ", *shown).alias("path"), depth.alias("depth"), "value")


def _tree(r: _Request) -> DataFrame:
    return tree_expand(r.df, r.b["id"], r.b["parent"], r.b.get("label") or r.b["id"])


def _radar(r: _Request) -> DataFrame:
    """Each metric scaled to 0..1 between its smallest and largest category."""
    names = list(r.b["metrics"])
    df = r.df.groupBy(r.b["category"]).agg(*[r.dataset.metric(m).column(m) for m in names])
    bounds = df.agg(F.struct(*[e for m in names for e in (
        F.min(m).cast("double").alias(f"{m}_low"),
        F.nullif((F.max(m) - F.min(m)).cast("double"), F.lit(0.0)).alias(f"{m}_span"))])).scalar()
    return df.withColumns({
        f"{m}_scaled": F.coalesce((c(m).cast("double") - bounds[f"{m}_low"]) / bounds[f"{m}_span"], F.lit(0.0)) for m in names})


def graph(edges: DataFrame, source: str, target: str, weight: str | None = None) -> DataFrame:
    """Distinct edges with weight, plus the number of distinct neighbours at both ends."""
    total = F.sum(weight) if weight else F.count("*")
    folded = edges.groupBy(c(source).alias("source"), c(target).alias("target")).agg(total.alias("weight"))
    out = folded.groupBy("source").agg(F.count("*").alias("source_out_degree"))
    into = folded.groupBy("target").agg(F.count("*").alias("target_in_degree"))
    return join_null_safe(join_null_safe(folded, out, ["source"]), into, ["target"])


def _graph(r: _Request) -> DataFrame:
    return graph(r.df, r.b["source"], r.b["target"], r.b.get("weight"))


def _table(r: _Request) -> DataFrame:
    cols = list(r.b["columns"])
    names = list(r.b.get("metrics") or [])
    df = r.df.groupBy(*cols).agg(*[r.dataset.metric(m).column(m) for m in names]) if names else r.df.select(*cols)
    first = r.b.get("order_by")
    order = [c(first).desc()] if first in names else ([c(first)] if first else [])
    return r.cut(df.orderBy(*order, *cols))


def _pivot_table(r: _Request) -> DataFrame:
    """``columns`` maps the pivoted column to its values, which keeps one job and a stable schema."""
    (column, values), = r.b["columns"].items()
    names = list(r.b["metrics"])
    return (r.df.groupBy(*r.b["groupby"]).pivot(column, list(values))
            .agg(*[r.dataset.metric(m).column(m) for m in names]))


def _choropleth(r: _Request) -> DataFrame:
    return r.df.groupBy(c(r.b["geo"]).alias("geo")).agg(r.metric())


def scatter_map(df: DataFrame, lat: str, lon: str, size: str | None = None, color: str | None = None,
                cell: float = 1.0) -> DataFrame:
    """Points folded to grid cells, one row per colour in a cell."""
    def corner(x: str):
        return F.floor(c(x) / cell).cast("double") * cell

    aggs = [F.count("*").alias("points")] + ([F.sum(size).alias("size")] if size else [])
    shade = [c(color).alias("color")] if color else []
    return df.groupBy(corner(lat).alias("lat"), corner(lon).alias("lon"), *shade).agg(*aggs)


def _scatter_map(r: _Request) -> DataFrame:
    return scatter_map(r.df, r.b["lat"], r.b["lon"], r.b.get("size"), r.b.get("color"))


def _boxplot(r: _Request) -> DataFrame:
    return boxplot(r.df, r.b["category"], r.b["metric"])


def _histogram(r: _Request) -> DataFrame:
    """Equal-width bins between smallest and largest value; the largest belongs to the last bin."""
    x, bins = c(r.b["column"]).cast("double"), int(r.b.get("bins") or 10)
    base = r.df.filter(x.isNotNull())
    bounds = base.agg(F.struct(F.min(x).alias("low"), F.nullif(F.max(x) - F.min(x), F.lit(0.0)).alias("width"))).scalar()
    place = F.coalesce(F.floor((x - bounds["low"]) / bounds["width"] * bins), F.lit(0)) + 1
    return base.groupBy(F.least(F.lit(bins).cast("bigint"), place).alias("bin")).agg(F.count("*").alias("n"))


def word_cloud(df: DataFrame, text: str, size=None, row_limit: int | None = None) -> DataFrame:
    """Most frequent words of the whole texts."""
    words = df.select(F.explode_outer(F.split(F.lower(c(text)), r"[^\p{L}\p{Nd}]+")).alias("word"),
                      *([c(size).alias("_size")] if size else []))
    total = F.sum("_size") if size else F.count("*")
    counted = words.filter("word <> ''").groupBy("word").agg(total.alias("size")).orderBy(c("size").desc(), "word")
    return counted if row_limit is None else counted.limit(row_limit)


def _word_cloud(r: _Request) -> DataFrame:
    return word_cloud(r.df, r.b["text"], None if r.b["size"] == "count" else r.b["size"], r.row_limit)


_BUILD: dict[str, Callable[[_Request], DataFrame]] = {
    "line": _line, "area": _area, "bar": _bar, "bar_stacked": _bar_stacked, "pie": _pie, "donut": _pie,
    "scatter": _scatter, "bubble": _bubble, "heatmap": _heatmap, "calendar_heatmap": _calendar_heatmap,
    "funnel": _funnel, "gauge": _gauge, "kpi": _kpi, "kpi_total": _kpi_total, "treemap": _treemap,
    "sunburst": _sunburst, "tree": _tree, "radar": _radar, "graph": _graph, "table": _table,
    "pivot_table": _pivot_table, "choropleth": _choropleth, "scatter_map": _scatter_map, "boxplot": _boxplot,
    "histogram": _histogram, "word_cloud": _word_cloud,
}
_NOT_COLUMNS = {"metric", "metrics", "time_grain", "stacked", "orientation", "min", "max", "compare_lag", "bins",
                "map_type", "order_by"}


def _needed(dataset: Dataset, kind: str, bindings: dict, filters: list[Filter], time: str | None) -> list[str]:
    names = [f.subject for f in filters] + ([time] if time else [])
    metrics: list[Metric] = []
    for key, value in bindings.items():
        if key in ("metric", "metrics") and kind != "boxplot":
            metrics += [dataset.metric(m) for m in ([value] if isinstance(value, str) else value)]
        elif key == "metric" or key not in _NOT_COLUMNS:
            names += [value] if isinstance(value, str) else list(value)
    for m in metrics:
        names += m.uses
    return [n for n in names if n in dataset.columns or n != "count"]


def chart(dataset: Dataset, kind: str, *, filters: list[Filter] = (), time_range: str | None = None,
          time_column: str | None = None, as_of: dt.date | None = None, row_limit: int | None = None,
          base: DataFrame | None = None, **bindings) -> DataFrame:
    """Build the data behind one chart. ``base`` replaces loading (a dashboard shares one)."""
    check_bindings(kind, bindings)
    bindings = {k: v for k, v in bindings.items() if v is not None}
    time_column = time_column or bindings.get("time")
    used_time = time_column if time_range else None
    df = base if base is not None else dataset.load(_needed(dataset, kind, bindings, list(filters), used_time))
    df = filtered(df, list(filters), time_range, time_column, as_of)
    return _BUILD[kind](_Request(df, dataset, bindings, row_limit))
