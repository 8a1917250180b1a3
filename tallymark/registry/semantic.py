from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallymark.operators.joins import join_null_safe
from tallymark.plans import semantic as sm
from tallymark.plans import sketches
from tallymark.plans.periods import time_range_filter
from tallymark.registry.core import half_up, query
from tallymark.session import materialize
from tallymark.sources.warehouse import external_table_scan

AS_OF = dt.date(1997, 6, 15)


def avg4(col: str) -> str:
    """Check SQL: AVG of a four-place decimal at eight places."""
    return half_up(f"CAST(SUM({col}) * 10000 AS HUGEINT)", f"COUNT({col}) * 10000", 8)


MARGIN = f"COALESCE({half_up('CAST(SUM(profit) * 10000 AS HUGEINT)', 'NULLIF(CAST(SUM(revenue) * 10000 AS HUGEINT), 0)', 10)}, 0)"


def _metric(t, name: str, by: str = "region"):
    data = sm.sales_dataset(t)
    m = data.metric(name)
    return data.load([by, *m.uses]).groupBy(by).agg(m.column("value"))


for _key, _name, _sql in (
        ("metric_sum", "total_revenue", "SUM(revenue)"), ("metric_count", "order_count", "COUNT(*)"),
        ("metric_avg", "avg_order_value", avg4("revenue")),
        ("metric_count_distinct", "unique_customers", "COUNT(DISTINCT customer_id)"),
        ("metric_ratio", "profit_margin", MARGIN),
        ("metric_filtered", "building_revenue", "SUM(revenue) FILTER (WHERE segment = 'BUILDING')")):
    query(_key, "region:s value:d", f"SELECT region, {_sql} AS value FROM fact_sales GROUP BY 1", "fact_sales")(
        lambda t, name=_name: _metric(t, name))


BOUND = sketches.error_bound()


def daily_sketches(t):
    """Customers per day, region and segment as stored sketches; the queries below unite them along other lines."""
    return materialize(sketches.distinct_sketches(sm.sales_dataset(t), "unique_customers", "order_date", ["region", "segment"]), "sketches")


def _within(exact: str = "exact", value: str = "value"):
    return F.abs(F.col(value) - F.col(exact)) <= F.col(exact) * F.lit(BOUND)


@query("metric_approx_distinct", "region:s exact:l bound:d united_within:b metric_within:b",
       f"""SELECT region, COUNT(DISTINCT customer_id) AS exact, {BOUND!r} AS bound, true AS united_within, true AS metric_within
 FROM fact_sales GROUP BY 1""", "fact_sales")
def metric_approx_distinct(t):
    """Sketches per day united by region, and the approximate metric itself, both within the stated bound of the exact count."""
    data = sm.sales_dataset(t)
    m = data.metric("unique_customers", approx=True)
    rows = data.load(["region", *m.uses]).groupBy("region").agg(data.metric("unique_customers").column("exact"), m.column("direct"))
    both = join_null_safe(rows, sketches.united(daily_sketches(t), "region"), ["region"])
    return both.select("region", "exact", F.lit(BOUND).alias("bound"), _within().alias("united_within"),
                       _within(value="direct").alias("metric_within"))


@query("sketch_rollup", "segment:s month:s exact:l within:b",
       """SELECT segment, CAST(DATE_TRUNC('month', order_date) AS DATE) AS month, COUNT(DISTINCT customer_id) AS exact, true AS within
 FROM fact_sales GROUP BY 1, 2""", "fact_sales")
def sketch_rollup(t):
    """The same stored sketches per segment and month, kept in two parts as if one of them had come later."""
    stored = daily_sketches(t)
    late = F.dayofmonth("day") > 20
    again = sketches.merged(stored.filter(~late).unionByName(stored.filter(late)).unionByName(stored.filter(F.dayofmonth("day") < 5)))
    found = sketches.united(again, "segment", F.trunc("day", "MM").alias("month"))
    exact = sm.sales_dataset(t).load(["segment", "order_date", "customer_id"]).groupBy("segment", F.trunc("order_date", "MM").alias("month")) \
        .agg(F.countDistinct("customer_id").alias("exact"))
    both = join_null_safe(exact, found, ["segment", "month"])
    return both.withColumn("within", _within())


@query("adhoc_filters", "segment:s n:l revenue:d",
       """SELECT segment, COUNT(*) AS n, SUM(revenue) AS revenue FROM fact_sales WHERE region = 'ASIA' AND channel IN ('A', 'R')
 AND quantity >= 10 AND brand <> 'Brand#1' AND category LIKE '%O%' AND segment IS NOT NULL GROUP BY 1""", "fact_sales")
def adhoc_filters(t):
    filters = [sm.Filter("region", "ASIA"), sm.Filter("channel", ["A", "R"], "IN"), sm.Filter("quantity", 10, ">="),
               sm.Filter("brand", "Brand#1", "!="), sm.Filter("category", "%O%", "LIKE"),
               sm.Filter("segment", operator="IS NOT NULL")]
    df = sm.sales_dataset(t).load(["segment", "region", "channel", "quantity", "brand", "category", "revenue"])
    return sm.adhoc_filters(df, filters).groupBy("segment").agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"))


@query("time_range_filter", "channel:s n:l revenue:d",
       """SELECT channel, COUNT(*) AS n, SUM(revenue) AS revenue FROM fact_sales WHERE order_date >= DATE '1997-05-16'
 AND order_date < DATE '1997-06-15' GROUP BY 1""", "fact_sales")
def time_range(t):
    df = sm.sales_dataset(t).load(["channel", "order_date", "revenue"])
    df = time_range_filter(df, "order_date", "Last 30 days", AS_OF)
    return df.groupBy("channel").agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"))


@query("related_column", "p_brand:s p_type:s n:l",
       "SELECT p_brand, p_type, COUNT(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def related_column(t):
    return (sm.related_column(t.lineitem.select("l_partkey"), t.part, "l_partkey", "p_partkey", ["p_brand", "p_type"])
            .groupBy("p_brand", "p_type").agg(F.count("*").alias("n")))


@query("retarget", "client_customer_id:l metric_name:s value:d",
       "SELECT customer_id AS client_customer_id, 'Client A Revenue' AS metric_name, SUM(revenue) AS value FROM fact_sales GROUP BY 1",
       "fact_sales")
def retarget(t):
    df = (sm.sales_dataset(t).load(["customer_id", "revenue"]).groupBy("customer_id")
          .agg(F.sum("revenue").alias("value")).withColumn("metric_name", F.lit("Total Revenue")))
    renamed = sm.retarget(df, {"customer_id": "client_customer_id", "order_date": "transaction_date"})
    return sm.retarget_names(renamed, "metric_name", {"Total Revenue": "Client A Revenue"})


@query("external_table_scan", "o_orderkey:l o_custkey:l o_totalprice:d",
       "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'")
def external_scan(t):
    return external_table_scan(t.spark, f"{t.folder}/orders.parquet", "orders", "o_orderdate", dt.date(1999, 1, 1))


@query("row_limit", "customer_id:l value:d",
       "SELECT customer_id, SUM(revenue) AS value FROM fact_sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000", "fact_sales")
def row_limit(t):
    df = sm.sales_dataset(t).load(["customer_id", "revenue"]).groupBy("customer_id").agg(F.sum("revenue").alias("value"))
    return df.orderBy(F.col("value").desc(), "customer_id").limit(1000)


@query("top_n_bar", "brand:s value:d",
       "SELECT brand, SUM(revenue) AS value FROM fact_sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "fact_sales")
def top_n_bar(t):
    from tallymark.plans.charts import TOP_N, chart

    return chart(sm.sales_dataset(t), "bar", metric="total_revenue", category="brand", row_limit=TOP_N)


@query("top_names", "name:s num:l", "SELECT name, SUM(num) AS num FROM names GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "names")
def top_names(t):
    return (t.view("names").groupBy("name").agg(F.sum("num").alias("num"))
            .orderBy(F.col("num").desc(), "name").limit(10))
