from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallymark.operators import series
from tallymark.plans import charts as ch
from tallymark.plans.chart_catalog import VISUALS
from tallymark.plans.dashboard import retail_dashboard
from tallymark.plans.semantic import Dataset, Field, Metric, sales_dataset
from tallymark.registry.core import half_up, query
from tallymark.registry.semantic import MARGIN, avg4
from tallymark.session import materialize

AS_OF = dt.date(1997, 6, 15)
FS = "fact_sales"


def _chart(t, kind, **options):
    return ch.chart(sales_dataset(t), kind, **options)


@query("chart_line", "time:s segment:s value:d",
       """SELECT CAST(DATE_TRUNC('month', order_date) AS DATE) AS time, segment, SUM(revenue) AS value FROM fact_sales
 GROUP BY 1, 2""", FS)
def chart_line(t):
    return _chart(t, "line", metric="total_revenue", time="order_date", group_by="segment", time_grain="P1M")


@query("chart_line_daily", "time:s value:d",
       """SELECT order_date AS time, SUM(revenue) AS value FROM fact_sales WHERE order_date >= DATE '1996-06-15'
 AND order_date < DATE '1997-06-15' GROUP BY 1""", FS)
def chart_line_daily(t):
    return _chart(t, "line", metric="total_revenue", time="order_date", time_range="Last year", as_of=AS_OF)


@query("chart_area", "time:s region:s value:d stack_top:d",
       """SELECT *, SUM(value) OVER (PARTITION BY time ORDER BY region) AS stack_top FROM
 (SELECT CAST(DATE_TRUNC('month', order_date) AS DATE) AS time, region, SUM(revenue) AS value FROM fact_sales GROUP BY 1, 2) z""", FS)
def chart_area(t):
    return _chart(t, "area", metric="total_revenue", time="order_date", group_by="region", stacked=True, time_grain="P1M")


@query("chart_bar", "category:s value:d",
       "SELECT category, SUM(profit) AS value FROM fact_sales GROUP BY 1", FS)
def chart_bar(t):
    return _chart(t, "bar", metric="total_profit", category="category")


@query("chart_bar_stacked", "segment:s channel:s value:d stack_base:d stack_top:d",
       """SELECT *, stack_top - value AS stack_base FROM (SELECT *, SUM(value) OVER (PARTITION BY segment ORDER BY channel) AS stack_top
 FROM (SELECT segment, channel, SUM(revenue) AS value FROM fact_sales GROUP BY 1, 2) z) y""", FS)
def chart_bar_stacked(t):
    return _chart(t, "bar_stacked", metric="total_revenue", category="segment", stack_by="channel")


SHARE = """SELECT {by}, value, CAST(value AS DOUBLE) / CAST(SUM(value) OVER () AS DOUBLE) AS share FROM
 (SELECT {by}, {agg} AS value FROM fact_sales GROUP BY 1) z"""


@query("chart_pie", "channel:s value:d share:d", SHARE.format(by="channel", agg="SUM(revenue)"), FS)
def chart_pie(t):
    return _chart(t, "pie", metric="total_revenue", category="channel")


@query("chart_donut", "category:s value:d share:d", SHARE.format(by="category", agg="COUNT(*)"), FS)
def chart_donut(t):
    return _chart(t, "donut", metric="order_count", category="category")


@query("share_of_total", "customer_id:l value:d share:d", SHARE.format(by="customer_id", agg="SUM(revenue)"), FS)
def share_of_total(t):
    df = sales_dataset(t).load(["customer_id", "revenue"])
    return series.share_of_total(df, ["customer_id"], F.sum("revenue"))


@query("chart_scatter", "quantity:d revenue:d channel:s",
       "SELECT quantity, revenue, channel FROM fact_sales", FS)
def chart_scatter(t):
    return _chart(t, "scatter", x="quantity", y="revenue", category="channel")


@query("chart_bubble", "category:s x:d y:d size:d",
       f"""SELECT category, {half_up('CAST(SUM(quantity) * 100 AS HUGEINT)', 'COUNT(quantity) * 100', 6)} AS x,
 {avg4('revenue')} AS y, SUM(profit) AS size FROM fact_sales GROUP BY 1""", FS)
def chart_bubble(t):
    return _chart(t, "bubble", x="quantity", y="revenue", size="profit", category="category")


@query("chart_heatmap", "region:s category:s value:d",
       f"SELECT region, category, {MARGIN} AS value FROM fact_sales GROUP BY 1, 2", FS)
def chart_heatmap(t):
    return _chart(t, "heatmap", x="region", y="category", metric="profit_margin")


@query("chart_calendar_heatmap", "day:s year:l week:l weekday:l value:d",
       """SELECT order_date AS day, YEAR(order_date) AS year, WEEK(order_date) AS week, DAYOFWEEK(order_date) + 1 AS weekday,
 COUNT(DISTINCT customer_id) AS value FROM fact_sales GROUP BY 1""", FS)
def chart_calendar_heatmap(t):
    return _chart(t, "calendar_heatmap", date="order_date", metric="unique_customers")


def events_dataset(t) -> Dataset:
    return Dataset(lambda names: t.events.select(*(names.split() or ["event_id"])),
                   {"event_id": Field("BIGINT"), "user_id": Field("BIGINT"), "event_type": Field("VARCHAR"),
                    "value": Field("NUMERIC"), "ts": Field("TIMESTAMP", is_dttm=True)},
                   {"users": Metric("COUNT(DISTINCT user_id)", ("user_id",)), "events": Metric("COUNT(*)"),
                    "error_pct": Metric("100 * CAST(COUNT_IF(event_type = 'error') AS DOUBLE) / COUNT(*)", ("event_type",))})


@query("chart_funnel", "event_type:s value:d step_rate:d",
       """SELECT *, CAST(value AS DOUBLE) / LAG(value) OVER (ORDER BY value DESC, event_type) AS step_rate FROM
 (SELECT event_type, COUNT(*) AS value FROM events GROUP BY 1) z""")
def chart_funnel(t):
    return ch.chart(events_dataset(t), "funnel", metric="events", category="event_type")


@query("chart_gauge", "value:d fraction:d",
       """SELECT value, LEAST(1.0, GREATEST(0.0, (value - 0.0) / (50.0 - 0.0))) AS fraction FROM
 (SELECT 100 * CAST(COUNT(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / COUNT(*) AS value FROM events) z""")
def chart_gauge(t):
    return ch.chart(events_dataset(t), "gauge", metric="error_pct", max=50)


KPI_CTE = """spine AS (SELECT CAST(UNNEST(GENERATE_SERIES(MIN(order_date), MAX(order_date), INTERVAL 1 DAY)) AS DATE) AS day FROM fact_sales),
daily AS (SELECT s.day, COALESCE(v, 0) AS value FROM spine s LEFT JOIN
 (SELECT order_date, SUM(revenue) AS v FROM fact_sales GROUP BY 1) d ON d.order_date = s.day),
lagged AS (SELECT *, LAG(value, 7) OVER (ORDER BY day) AS previous FROM daily),
kpi AS (SELECT *, CAST(value - previous AS DOUBLE) / CAST(NULLIF(previous, 0) AS DOUBLE) * 100 AS change_pct FROM lagged)"""


def _daily(t):
    df = sales_dataset(t).load(["order_date", "revenue"])
    return series.dense_daily(df, F.col("order_date").cast("date"), F.sum("revenue"))


@query("kpi_compare_lag", "day:s value:d previous:d change_pct:d", "SELECT * FROM kpi", FS, KPI_CTE)
def kpi_compare_lag(t):
    return series.compare_lag(_daily(t), 7)


@query("chart_kpi", "day:s value:d previous:d change_pct:d", "SELECT * FROM kpi WHERE day = (SELECT MAX(day) FROM kpi)", FS, KPI_CTE)
def chart_kpi(t):
    return _chart(t, "kpi", metric="total_revenue", time="order_date", compare_lag=7)


ANOMALY_CTE = KPI_CTE + """,
cent AS (SELECT day, value, CAST(ROUND(value, 2) * 100 AS HUGEINT) AS x FROM daily),
trail AS (SELECT *, COUNT(x) OVER w AS n, SUM(x) OVER w AS s, SUM(x * x) OVER w AS q FROM cent
 WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
zed AS (SELECT day, value, CASE WHEN n >= 2 AND n * q - s * s > 0 THEN ROUND(CAST(n * x - s AS DOUBLE) /
 (SQRT(CAST(n * q - s * s AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) * CAST(n AS DOUBLE)), 6) END AS z FROM trail)"""


@query("kpi_anomaly", "day:s value:d z:d is_anomaly:b", "SELECT *, COALESCE(ABS(z) > 3, false) AS is_anomaly FROM zed", FS, ANOMALY_CTE)
def kpi_anomaly(t):
    return series.kpi_anomaly(_daily(t).withColumn("value", F.col("value").cast("decimal(30,4)")))


@query("chart_kpi_total", "value:d", f"SELECT {MARGIN} AS value FROM fact_sales", FS)
def chart_kpi_total(t):
    return _chart(t, "kpi_total", metric="profit_margin")


@query("chart_treemap", "region:s nation:s level_id:l value:d",
       """SELECT region, nation, GROUPING(region, nation) AS level_id, SUM(revenue) AS value FROM fact_sales
 GROUP BY ROLLUP (region, nation)""", FS)
def chart_treemap(t):
    return _chart(t, "treemap", metric="total_revenue", category="nation", hierarchy=["region"])


@query("chart_sunburst", "path:s depth:l value:d",
       """SELECT CASE GROUPING(region, nation, segment) WHEN 0 THEN region || ' / ' || nation || ' / ' || segment
 WHEN 1 THEN region || ' / ' || nation WHEN 3 THEN region ELSE '' END AS path,
 CASE GROUPING(region, nation, segment) WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS depth, COUNT(*) AS value
 FROM fact_sales GROUP BY ROLLUP (region, nation, segment)""", FS)
def chart_sunburst(t):
    return _chart(t, "sunburst", metric="order_count", category="segment", hierarchy=["region", "nation"])


@query("chart_tree", "id:s parent_id:s label:s depth:l path:s is_leaf:b subtree_size:l is_orphan:b",
       """SELECT d.id, d.parent_id, d.label, d.depth, d.path, NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = d.id) AS is_leaf,
 (SELECT COUNT(*) FROM down x WHERE x.root = d.id) AS subtree_size, false AS is_orphan FROM walk d""", "tree",
       """walk AS (SELECT id, parent_id, label, 0 AS depth, CAST(label AS VARCHAR) AS path FROM tree WHERE parent_id IS NULL
 UNION ALL SELECT t.id, t.parent_id, t.label, w.depth + 1, w.path || ' > ' || t.label FROM tree t JOIN walk w ON t.parent_id = w.id),
down AS (SELECT id AS root, id FROM tree UNION ALL SELECT d.root, t.id FROM tree t JOIN down d ON t.parent_id = d.id)""")
def chart_tree(t):
    data = Dataset(lambda names: t.view("tree"), {n: Field("VARCHAR") for n in ("id", "parent_id", "label")})
    return ch.chart(data, "tree", id="id", parent="parent_id", label="label")


@query("chart_radar", "segment:s total_revenue:d unique_customers:d total_revenue_scaled:d unique_customers_scaled:d",
       """SELECT *, (CAST(total_revenue AS DOUBLE) - CAST(MIN(total_revenue) OVER () AS DOUBLE))
 / CAST(MAX(total_revenue) OVER () - MIN(total_revenue) OVER () AS DOUBLE) AS total_revenue_scaled,
 CAST(unique_customers - MIN(unique_customers) OVER () AS DOUBLE)
 / CAST(MAX(unique_customers) OVER () - MIN(unique_customers) OVER () AS DOUBLE) AS unique_customers_scaled FROM
 (SELECT segment, SUM(revenue) AS total_revenue, COUNT(DISTINCT customer_id) AS unique_customers FROM fact_sales GROUP BY 1) z""", FS)
def chart_radar(t):
    return _chart(t, "radar", category="segment", metrics=["total_revenue", "unique_customers"])


@query("chart_table", "region:s segment:s total_revenue:d order_count:l",
       """SELECT region, segment, SUM(revenue) AS total_revenue, COUNT(*) AS order_count FROM fact_sales GROUP BY 1, 2""", FS)
def chart_table(t):
    return _chart(t, "table", columns=["region", "segment"], metrics=["total_revenue", "order_count"], order_by="total_revenue")


@query("chart_pivot_table", "segment:s A:d N:d R:d",
       """SELECT segment, SUM(revenue) FILTER (WHERE channel = 'A') AS "A", SUM(revenue) FILTER (WHERE channel = 'N') AS "N",
 SUM(revenue) FILTER (WHERE channel = 'R') AS "R" FROM fact_sales GROUP BY 1""", FS)
def chart_pivot_table(t):
    return _chart(t, "pivot_table", groupby=["segment"], columns={"channel": ["A", "N", "R"]}, metrics=["total_revenue"])


@query("chart_choropleth", "geo:s value:d", f"SELECT nation AS geo, {avg4('revenue')} AS value FROM fact_sales GROUP BY 1", FS)
def chart_choropleth(t):
    return _chart(t, "choropleth", geo="nation", metric="avg_order_value")


@query("chart_scatter_map", "lat:d lon:d points:l size:d",
       """SELECT FLOOR(((c_custkey * 37) % 1800) / 10.0 - 90) AS lat, FLOOR(((c_custkey * 53) % 3600) / 10.0 - 180) AS lon,
 COUNT(*) AS points, SUM(CAST(c_acctbal AS DECIMAL(12,2))) AS size FROM customer GROUP BY 1, 2""")
def chart_scatter_map(t):
    places = t.customer.selectExpr(
        "CAST((c_custkey * 37) % 1800 AS DOUBLE) / 10.0 - 90 AS lat", "CAST((c_custkey * 53) % 3600 AS DOUBLE) / 10.0 - 180 AS lon",
        "CAST(c_acctbal AS DECIMAL(12,2)) AS balance")
    data = Dataset(lambda names: places, {n: Field("DOUBLE") for n in ("lat", "lon", "balance")})
    return ch.chart(data, "scatter_map", lat="lat", lon="lon", size="balance")


@query("chart_boxplot", "segment:s q1:d median:d q3:d whisker_low:d whisker_high:d outliers:l n_points:l",
       """SELECT f.segment, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3, MIN(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
 MAX(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 COUNT(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers, COUNT(*) AS n_points
 FROM (SELECT segment, CAST(revenue AS DOUBLE) AS x FROM fact_sales) f JOIN quart USING (segment) GROUP BY f.segment, quart.q1, quart.median, quart.q3""", FS,
       """quart AS (SELECT segment, QUANTILE_CONT(CAST(revenue AS DOUBLE), 0.25) AS q1, QUANTILE_CONT(CAST(revenue AS DOUBLE), 0.5) AS median,
 QUANTILE_CONT(CAST(revenue AS DOUBLE), 0.75) AS q3 FROM fact_sales GROUP BY 1)""")
def chart_boxplot(t):
    df = _chart(t, "boxplot", metric="revenue", category="segment")
    return df.withColumns({q: F.round(q, 6) for q in ("q1", "median", "q3")})


@query("chart_histogram", "bin:l n:l",
       """SELECT LEAST(20, CAST(FLOOR((CAST(revenue AS DOUBLE) - lo) / (hi - lo) * 20) AS BIGINT) + 1) AS bin, COUNT(*) AS n FROM fact_sales,
 (SELECT MIN(CAST(revenue AS DOUBLE)) AS lo, MAX(CAST(revenue AS DOUBLE)) AS hi FROM fact_sales) m GROUP BY 1""", FS)
def chart_histogram(t):
    return _chart(t, "histogram", column="revenue", bins=20)


def documents_dataset(t) -> Dataset:
    return Dataset(lambda names: t.documents.select(*names.split()),
                   {"text": Field("VARCHAR"), "lang": Field("VARCHAR"), "n_chars": Field("BIGINT")})


@query("chart_word_cloud", "word:s size:l",
       r"""SELECT word, COUNT(*) AS size FROM (SELECT UNNEST(REGEXP_SPLIT_TO_ARRAY(LOWER(text), '[^\p{L}\p{Nd}]+')) AS word FROM documents) z
 WHERE word <> '' GROUP BY 1""")
def chart_word_cloud(t):
    return ch.chart(documents_dataset(t), "word_cloud", text="text", size="count")


_VISUAL_NAMES = [*VISUALS, "slicer", "image"]


@query("visual_mapping", "visual:s kind:s n:l",
       "SELECT visual, CASE visual " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VISUALS.items())
       + f" END AS kind, COUNT(*) AS n FROM (SELECT {_VISUAL_NAMES!r}[CAST(l_partkey % 25 AS INT) + 1] AS visual FROM lineitem) z GROUP BY 1, 2")
def visual_mapping(t):
    from tallymark.operators.resolve import map_visuals

    names = F.array(*[F.lit(v) for v in _VISUAL_NAMES])
    rows = t.lineitem.select(F.element_at(names, (F.col("l_partkey") % 25 + 1).cast("int")).alias("visual"))
    return map_visuals(rows.groupBy("visual").agg(F.count("*").alias("n")))


_DASH = "SELECT * FROM fact_sales WHERE order_date >= DATE '1996-06-15' AND order_date < DATE '1997-06-15' AND category IN ('PROMO', 'LARGE')"


@query("dashboard_bundle", "chart:s label:s value:d",
       """SELECT 'revenue_trend' AS chart, CAST(order_date AS VARCHAR) AS label, SUM(revenue) AS value FROM dash GROUP BY 2
 UNION ALL (SELECT 'top_products', product_name, SUM(revenue) FROM dash GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
 UNION ALL (SELECT 'top_categories', category, SUM(revenue) FROM dash GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
 UNION ALL SELECT 'total_revenue_kpi', CAST(order_date AS VARCHAR), SUM(revenue) FROM dash
   WHERE order_date = (SELECT MAX(order_date) FROM dash) GROUP BY 2
 UNION ALL SELECT 'order_count_kpi', CAST(order_date AS VARCHAR), COUNT(*) FROM dash
   WHERE order_date = (SELECT MAX(order_date) FROM dash) GROUP BY 2""", FS, f"dash AS ({_DASH})")
def dashboard_bundle(t):
    board = retail_dashboard(sales_dataset(t))
    charts = board.build(board.base("Last year", AS_OF, ["PROMO", "LARGE"]))
    label = {"revenue_trend": "time", "top_products": "product_name", "top_categories": "category",
             "total_revenue_kpi": "day", "order_count_kpi": "day"}
    parts = [df.select(F.lit(name).alias("chart"), F.col(label[name]).cast("string").alias("label"),
                       F.col("value").cast("double")) for name, df in charts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
