from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.registry.core import query
from tallymark.session import work_dir
from tallymark.sources import warehouse as wh
from tallymark.sources.catalog_json import read_sites
from tallymark.sources.export import runtime_export
from tallymark.sources.tables import scan_dataset

NAME_KEY = ["state", "year", "gender", "name"]
NAME_SPEC = "state:s year:l gender:s name:s num:l"


@query("scan_dataset", "event_id:l user_id:l event_type:s value:d props:s", "SELECT * FROM events")
def scan(t):
    return scan_dataset(t.spark, t.folder, "events")


@query("seed_load_idempotent", NAME_SPEC, "SELECT * FROM names", "names")
def seed_load_idempotent(t):
    """The first load holds one state; two full loads follow, and nothing is doubled."""
    names = t.view("names")
    path = work_dir(t.spark, "names")
    names.filter("state = 'F'").write.parquet(path)
    wh.idempotent_load(t.spark, path, names, NAME_KEY)
    wh.idempotent_load(t.spark, path, names, NAME_KEY)
    return t.spark.read.schema(names.schema).parquet(path)


@query("migration_ledger", "version:s applied_by:s",
       """SELECT version, CASE WHEN BOOL_OR(o_orderstatus = 'F') THEN 'first run' ELSE 'second run' END AS applied_by FROM
 (SELECT STRFTIME(o_orderdate, '%Y_%m_') || o_orderpriority AS version, o_orderstatus FROM orders) z GROUP BY 1""")
def migration_ledger(t):
    """Versions applied by a first run are not applied again by the second."""
    rows = t.orders.select(F.concat(F.date_format("o_orderdate", "yyyy_MM_"), "o_orderpriority").alias("version"), "o_orderstatus")
    ledger = (rows.filter("o_orderstatus = 'F'").select("version").distinct().withColumn("applied_by", F.lit("first run")))
    incoming = rows.select("version").withColumn("applied_by", F.lit("second run"))
    return ledger.unionByName(wh.insert_if_absent(ledger, incoming, ["version"]))


@query("ad_hoc_sql", "state:s n:l total:l", "SELECT state, COUNT(*) AS n, SUM(num) AS total FROM names GROUP BY 1", "names")
def ad_hoc_sql(t):
    text = "SELECT state, COUNT(*) AS n, SUM(num) AS total FROM {names} GROUP BY state ORDER BY state"
    return wh.ad_hoc_sql(t.spark, text, {"names": t.view("names")}, limit=1000)


SEGMENT_SQL = "SELECT segment, channel, SUM(revenue) AS revenue, COUNT(*) AS n FROM fact_sales GROUP BY 1, 2"


def _by_segment(t):
    return (t.view("fact_sales", columns="segment channel revenue").groupBy("segment", "channel")
            .agg(F.sum("revenue").alias("revenue"), F.count("*").alias("n")))


@query("ctas", "segment:s channel:s revenue:d n:l", SEGMENT_SQL, "fact_sales")
def ctas(t):
    return wh.create_table_as(_by_segment(t), "segments", partition_by=["channel"])


@query("cvas", "segment:s channel:s revenue:d n:l", SEGMENT_SQL, "fact_sales")
def cvas(t):
    return wh.create_view_as(_by_segment(t), "tallymark_segments")


CHUNK = 500


@query("nested_json_scan", "site_id:s id:s url:s page_type:s n_tags:l first_point:s",
       """SELECT REGEXP_EXTRACT(url, '://([^/?#]*)', 1) AS site_id, 'page_' || page_id AS id, url,
 CASE WHEN url LIKE '%.html%' THEN 'leaf' ELSE 'index' END AS page_type, 2 AS n_tags,
 CASE WHEN url LIKE '%.html%' THEN 'length ' || LENGTH(html) END AS first_point FROM pages""")
def nested_json_scan(t):
    """Site documents with nested nodes are written, then read back through the declared schema.

    A site's nodes are cut into documents of at most ``CHUNK`` page ids each.
    """
    points = F.when(F.col("url").contains(".html"), F.struct(
        F.array(F.concat(F.lit("length "), F.length("html").cast("string"))).alias("key_points")))
    node = F.struct(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("id"), F.col("url"),
                    F.when(F.col("url").contains(".html"), "leaf").otherwise("index").alias("page_type"),
                    F.array(F.lit("web"), F.lit("page")).alias("tags"), points.alias("leaf_extractions"))
    path = work_dir(t.spark, "sites")
    (t.pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("site_id"), F.floor(F.col("page_id") / CHUNK).alias("part"))
     .agg(F.collect_list(node).alias("nodes")).select("site_id", "nodes").write.json(path))
    return read_sites(t.spark, path).select(
        "site_id", "id", "url", "page_type", F.size("tags").alias("n_tags"), F.get("leaf_extractions.key_points", F.lit(0)).alias("first_point"))


@query("runtime_export", "asset_type:s n:l n_names:l",
       "SELECT asset_type, COUNT(*) AS n, COUNT(DISTINCT name) AS n_names FROM assets_runtime GROUP BY 1", "assets_runtime")
def export(t):
    return runtime_export(t.view("assets_runtime"), work_dir(t.spark, "export"))
