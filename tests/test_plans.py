"""Plan checks: no Python workers, no cross products, filters and columns reach the scan."""

import re

import pytest

from tallymark.plans.charts import chart
from tallymark.plans.semantic import Filter, sales_dataset
from tallymark.registry import queries
from tallymark.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"
EAGER = {"findings_sink", "chart_boxplot", "tool_adoption", "chart_tree", "tree_expand"}


def plan(spark, key):
    return queries()[key](spark, FOLDER)._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", sorted(k for k in queries() if not k.startswith("stream") and k not in EAGER))
def test_no_python_and_no_cross_join(spark, key):
    text = plan(spark, key)
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


@pytest.mark.parametrize("key,column", [("external_table_scan", "o_orderdate"), ("time_range_filter", "o_orderdate"),
                                        ("chart_line_daily", "o_orderdate"), ("invoice_search", "o_orderdate"), ("period_filter", "o_orderdate"),
                                        ("tm_invoice_lines", "l_shipdate"),
                                        ("timesheet_link", "l_shipdate")])
def test_filter_reaches_the_scan(spark, key, column):
    assert re.search(rf"PushedFilters: \[[^\]]*{column}", plan(spark, key))


def test_chart_filter_reaches_the_scan(spark):
    df = chart(sales_dataset(Tables(spark, FOLDER)), "line", metric="total_revenue", time="order_date", group_by="segment",
               filters=[Filter("channel", "A")])
    assert re.search(r"PushedFilters: \[[^\]]*l_returnflag", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("key,unread", [("chart_pie", ["orders", "customer", "part"]), ("metric_sum", ["part"]), ("top_n_bar", ["orders", "customer"])])
def test_unused_dimensions_are_not_read(spark, key, unread):
    text = plan(spark, key)
    assert not any(f"/{name}.parquet" in text for name in unread)


def test_shared_order_fold_is_reused(spark):
    df = queries()["project_health"](spark, FOLDER)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
