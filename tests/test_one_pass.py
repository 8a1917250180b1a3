"""Dashboards from one pass, and approximate distinct counts from stored sketches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymark.plans import sketches
from tallymark.plans.charts import chart
from tallymark.plans.dashboard import ChartSpec, Dashboard, retail_dashboard
from tallymark.plans.semantic import Dataset, Field, Metric, sales_dataset
from tallymark.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"
REVENUE = {"metric": "total_revenue"}
CHARTS = {
    "line": ChartSpec("line", {**REVENUE, "time": "order_date", "time_grain": "P1M", "group_by": "segment"}),
    "area": ChartSpec("area", {**REVENUE, "time": "order_date", "time_grain": "P1Y", "group_by": "segment", "stacked": True}),
    "bar": ChartSpec("bar", {"metric": "unique_customers", "category": "segment"}),
    "top": ChartSpec("bar", {**REVENUE, "category": "product_name"}, 3),
    "pie": ChartSpec("pie", {"metric": "avg_order_value", "category": "category"}),
    "stacked": ChartSpec("bar_stacked", {**REVENUE, "category": "segment", "stack_by": "category"}),
    "heat": ChartSpec("heatmap", {"metric": "profit_margin", "x": "segment", "y": "category"}),
    "kpi": ChartSpec("kpi", {"metric": "order_count", "time": "order_date"}),
    "total": ChartSpec("kpi_total", {"metric": "profit_margin"}),
    "tree": ChartSpec("treemap", {**REVENUE, "category": "category", "hierarchy": ["segment"]}),
}
COLUMNS = ("order_date", "product_name", "category", "segment", "customer_id", "revenue", "profit")


def values(df):
    return sorted(map(str, df.collect()))


def test_charts_from_one_pass_equal_separate_charts(spark):
    data = sales_dataset(Tables(spark, FOLDER))
    board = Dashboard(data, COLUMNS, CHARTS, "order_date", "category")
    base = board.base("Last year", dt.date(1997, 6, 15), ["PROMO", "LARGE", "SMALL"])
    built = board.build(base)
    assert list(built) == list(CHARTS)
    for name, s in CHARTS.items():
        alone = chart(data, s.kind, base=base, row_limit=s.row_limit, **s.bindings)
        assert values(built[name].select(*alone.columns)) == values(alone), name
    assert built["top"].count() == 3


def test_one_scan_feeds_all_charts(spark):
    board = retail_dashboard(sales_dataset(Tables(spark, FOLDER)))
    plan = board.aggregated(board.base("Last year", dt.date(1997, 6, 15), ["PROMO"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/lineitem.parquet") == 1 and "Expand" in plan


def test_no_limit_unless_asked_for(spark):
    rows = spark.range(3000).selectExpr("CAST(id AS STRING) AS name", "1 AS v")
    data = Dataset(lambda names: rows, {"name": Field("VARCHAR"), "v": Field("NUMERIC")}, {"n": Metric("COUNT(*)")})
    board = Dashboard(data, ("name",), {"bar": ChartSpec("bar", {"metric": "n", "category": "name"}),
                                        "table": ChartSpec("table", {"columns": ["name"]})}, "t", "name")
    assert {k: df.count() for k, df in board.build(board.base()).items()} == {"bar": 3000, "table": 3000}
    only_table = Dashboard(data, ("name",), {"table": ChartSpec("table", {"columns": ["name"]})}, "t", "name")
    assert only_table.build(only_table.base())["table"].count() == 3000


@pytest.fixture(scope="module")
def visits(spark):
    """Each visitor comes on several days, so that days cannot be added up."""
    rows = spark.range(300_000).selectExpr("id * 7919 % 60000 AS who", "date_add(DATE'2024-01-01', CAST(id % 60 AS INT)) AS at",
                                           "CONCAT('s', id % 3) AS site")
    fields = {"who": Field("BIGINT"), "at": Field("DATE"), "site": Field("VARCHAR")}
    return Dataset(lambda names: rows, fields, {"people": Metric("COUNT(DISTINCT who)", ("who",), "count_distinct"),
                                                "visits": Metric("COUNT(*)", (), "count")})


def test_united_sketches_keep_the_bound(visits):
    stored = sketches.distinct_sketches(visits, "people", "at", ["site"])
    rows = visits.load(["who", "at", "site"])
    for keys, column in (([], None), (["site"], "site"), ([F.trunc("day", "MM").alias("m")], F.trunc("at", "MM").alias("m"))):
        exact = rows.groupBy(*([column] if column is not None else [])).agg(F.countDistinct("who").alias("n")).collect()
        found = sketches.united(stored, *keys).collect()
        pairs = dict(zip(sorted(map(str, (r[:-1] for r in exact))), (r[-1] for r in sorted(exact, key=lambda r: str(r[:-1])))))
        for r in found:
            assert abs(r[-1] - pairs[str(r[:-1])]) <= sketches.error_bound() * pairs[str(r[:-1])]
        assert len(found) == len(exact)


def test_sketches_merge_in_any_order(visits):
    stored = sketches.distinct_sketches(visits, "people", "at", ["site"]).cache()
    twice = sketches.merged(stored.unionByName(stored.filter("site = 's1'")))
    assert twice.count() == stored.count()
    assert values(sketches.united(twice, "site")) == values(sketches.united(stored, "site"))
    stored.unpersist()


def test_approximate_metric(visits):
    exact = {r.site: r.value for r in chart(visits, "bar", metric="people", category="site").collect()}
    close = {r.site: r.value for r in chart(visits.approximated(), "bar", metric="people", category="site").collect()}
    assert set(close) == set(exact) and all(abs(close[k] - n) <= sketches.error_bound() * n for k, n in exact.items())
    assert visits.metric("visits", approx=True) == visits.metric("visits")
    with pytest.raises(ValueError):
        sketches.distinct_sketches(visits, "visits", "at", [])
