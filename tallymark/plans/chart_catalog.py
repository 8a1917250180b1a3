"""Chart kinds: required and optional bindings, renderer candidates, and the visual mapping."""

from __future__ import annotations

# Per kind the required bindings, the optional ones, the preferred
# renderer types in order, and the fallback types in order.
KINDS = {
    "line": (("metric", "time"), ("group_by", "time_grain"),
             ("echarts_timeseries_line", "echarts_line", "echarts_timeseries"), ("line",)),
    "area": (("metric", "time"), ("group_by", "stacked", "time_grain"),
             ("echarts_timeseries_area", "echarts_area"), ("area", "line")),
    "bar": (("metric", "category"), ("orientation", "stacked"),
            ("echarts_bar", "echarts_timeseries_bar"), ("bar", "dist_bar")),
    "bar_stacked": (("metric", "category", "stack_by"), (), ("echarts_bar_stack", "echarts_bar"), ("bar",)),
    "pie": (("metric", "category"), (), ("echarts_pie",), ("pie",)),
    "donut": (("metric", "category"), (), ("echarts_pie",), ("pie",)),
    "scatter": (("x", "y"), ("category", "size"), ("echarts_scatter", "echarts_timeseries_scatter"), ("scatter",)),
    "bubble": (("x", "y", "size"), ("category",), ("echarts_bubble", "echarts_scatter"), ("bubble", "scatter")),
    "heatmap": (("x", "y", "metric"), (), ("echarts_heatmap",), ("heatmap", "cal_heatmap")),
    "calendar_heatmap": (("date", "metric"), (), ("echarts_heatmap",), ("cal_heatmap", "heatmap")),
    "funnel": (("metric", "category"), (), ("echarts_funnel",), ("funnel",)),
    "gauge": (("metric",), ("min", "max"), ("echarts_gauge",), ("big_number",)),
    "kpi": (("metric",), ("time", "compare_lag"), (), ("big_number", "big_number_total")),
    "kpi_total": (("metric",), (), (), ("big_number_total", "big_number")),
    "treemap": (("metric", "category"), ("hierarchy",), ("echarts_treemap",), ("treemap",)),
    "sunburst": (("metric", "category"), ("hierarchy",), ("echarts_sunburst",), ("sunburst",)),
    "tree": (("id", "parent"), ("label",), ("echarts_tree",), ("partition",)),
    "radar": (("category", "metrics"), (), ("echarts_radar",), ("bar",)),
    "graph": (("source", "target"), ("weight",), ("echarts_graph",), ("graph_chart",)),
    "table": (("columns",), ("metrics", "order_by"), (), ("table",)),
    "pivot_table": (("groupby", "columns", "metrics"), (), (), ("pivot_table", "pivot_table_v2")),
    "choropleth": (("geo", "metric"), ("map_type",), ("echarts_map",), ("country_map", "world_map")),
    "scatter_map": (("lat", "lon"), ("size", "color"), ("deck_scatter",), ("deck_scatter", "mapbox")),
    "boxplot": (("metric", "category"), (), ("echarts_boxplot",), ("box_plot",)),
    "histogram": (("column",), ("bins",), ("echarts_histogram",), ("histogram",)),
    "word_cloud": (("text", "size"), (), ("echarts_wordcloud",), ("word_cloud",)),
}

# External visual kind to chart kind.
VISUALS = {
    "clusteredColumnChart": "bar", "clusteredBarChart": "bar", "stackedColumnChart": "bar_stacked",
    "stackedBarChart": "bar_stacked", "lineChart": "line", "areaChart": "area", "lineStackedChart": "area",
    "pieChart": "pie", "donutChart": "donut", "card": "kpi", "multiRowCard": "kpi", "gauge": "gauge", "kpi": "kpi",
    "funnel": "funnel", "tableEx": "table", "matrix": "pivot_table", "scatterChart": "scatter", "map": "choropleth",
    "filledMap": "choropleth", "treemap": "treemap", "decompositionTree": "tree", "waterfall": "bar", "ribbon": "area",
}


def check_bindings(kind: str, given: dict) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown chart kind {kind!r}")
    required, optional = KINDS[kind][:2]
    missing = [b for b in required if given.get(b) is None]
    unknown = [b for b in given if b not in required + optional]
    if missing or unknown:
        raise ValueError(f"chart {kind}: missing bindings {missing}, unknown bindings {unknown}")
