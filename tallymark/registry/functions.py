"""Scalar building blocks, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import scalars as sc
from tallymark.functions.redact import detector_for_path, parse_db_url_sql, redact_url_sql, tags_for_path
from tallymark.functions.status import register_sql_functions
from tallymark.registry.core import query
from tallymark.registry.textscan import DETECTOR, TAGS

URL_SQL = """CONCAT('Postgres://u', CAST(c_custkey AS VARCHAR(20)), CASE c_custkey % 3 WHEN 0 THEN '' ELSE CONCAT(':p', CAST(c_custkey AS VARCHAR(20))) END,
 '@DB', CAST(c_nationkey AS VARCHAR(20)), '.Example.com', CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ':99999' ELSE ':5432' END, '/',
 LOWER(c_mktsegment), '?sslmode=require&api_key=k', CAST(c_custkey AS VARCHAR(20)), '&x=1')"""


@query("fn_redact_url", "c_custkey:l text:s fields:s",
       """SELECT c_custkey, 'postgres://u' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '' ELSE ':***REDACTED***' END || '@DB' || c_nationkey
 || '.Example.com' || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ':99999' ELSE ':5432' END || '/' || LOWER(c_mktsegment)
 || '?sslmode=require&api_key=***REDACTED***&x=1' AS text,
 'query:api_key' || CASE c_custkey % 3 WHEN 0 THEN '' ELSE ',url_password' END AS fields FROM customer""")
def fn_redact_url(t):
    df = t.customer.select("c_custkey", F.expr(URL_SQL).alias("url"))
    return df.select("c_custkey", F.expr(redact_url_sql("url")).alias("r")).select(
        "c_custkey", "r.text", F.array_join("r.fields", ",").alias("fields"))


@query("fn_parse_url", "c_custkey:l datastore_type:s host:s port:s database:s user:s ssl_mode:s",
       """SELECT c_custkey, 'postgres' AS datastore_type, 'db' || c_nationkey || '.example.com' AS host,
 CASE WHEN c_custkey % 4 > 1 THEN '5432' END AS port, LOWER(c_mktsegment) AS database, 'u' || c_custkey AS "user",
 'require' AS ssl_mode FROM customer""")
def fn_parse_url(t):
    df = t.customer.select("c_custkey", F.expr(URL_SQL).alias("url"))
    return df.select("c_custkey", F.expr(parse_db_url_sql("url")).alias("p")).select("c_custkey", "p.*")


@query("fn_path_rules", "path:s detector:s tags:s", f"SELECT path, {DETECTOR} AS detector, {TAGS} AS tags FROM corpus", "corpus")
def fn_path_rules(t):
    return t.view("corpus").select("path", detector_for_path(F.col("path")).alias("detector"),
                                   F.array_join(tags_for_path(F.col("path")), ",").alias("tags"))


@query("fn_slug_title", "p_partkey:l slug:s title:s",
       """SELECT p_partkey, REPLACE(LOWER(p_type || ' ' || p_name), ' ', '-') AS slug, UPPER(SUBSTR(p_name, 1, 1)) || SUBSTR(SPLIT_PART(p_name, ' ', 1), 2)
 || ' ' || UPPER(SUBSTR(SPLIT_PART(p_name, ' ', 2), 1, 1)) || SUBSTR(SPLIT_PART(p_name, ' ', 2), 2) AS title FROM part""")
def fn_slug_title(t):
    return t.part.select("p_partkey", sc.slug(F.concat_ws(" ", "p_type", "p_name")).alias("slug"),
                         sc.title_from_slug(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title"))


DAX = "CASE p_partkey % 3 WHEN 0 THEN CONCAT('DISTINCTCOUNT(Sales[', {b}, '])') WHEN 1 THEN CONCAT('AVERAGE(Sales[', {b}, '])') ELSE CONCAT('SUM(Sales[', {b}, '])') END"
_B = "REPLACE(p_brand, '#', '_')"


@query("fn_dax_to_sql", "p_partkey:l sql:s literal:s",
       f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'COUNT(DISTINCT ' || {_B} WHEN 1 THEN 'AVG(' || {_B} ELSE 'SUM(' || {_B} END || ')' AS sql,
 CASE p_partkey % 3 WHEN 0 THEN 'COUNT(DISTINCT Sales[' || {_B} WHEN 1 THEN 'AVG(Sales[' || {_B} ELSE 'SUM(Sales[' || {_B} END || '])' AS literal
 FROM part""")
def fn_dax_to_sql(t):
    df = t.part.select("p_partkey", F.expr(DAX.format(b=_B)).alias("dax"))
    return df.select("p_partkey", sc.dax_to_sql(F.col("dax")).alias("sql"), sc.dax_to_sql_literal(F.col("dax")).alias("literal"))


@query("fn_time_grains", "event_id:l hour_us:l day:s week:s month:s quarter:s year:s plus_30:s next_month:s",
       """SELECT event_id, EPOCH_US(DATE_TRUNC('hour', ts)) AS hour_us, CAST(ts AS DATE) AS day, CAST(DATE_TRUNC('week', ts) AS DATE) AS week,
 CAST(DATE_TRUNC('month', ts) AS DATE) AS month, CAST(DATE_TRUNC('quarter', ts) AS DATE) AS quarter, CAST(DATE_TRUNC('year', ts) AS DATE) AS year,
 CAST(ts AS DATE) + 30 AS plus_30, CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month FROM events""")
def fn_time_grains(t):
    ts, day = F.col("ts"), F.col("ts").cast("date")
    return t.view("events_ts").select(
        "event_id", F.unix_micros(sc.time_bucket(ts, "PT1H")).alias("hour_us"),
        *[sc.time_bucket(ts, g).alias(n) for g, n in (("P1D", "day"), ("P1W", "week"), ("P1M", "month"), ("P3M", "quarter"), ("P1Y", "year"))],
        F.date_add(day, 30).alias("plus_30"), F.add_months(day, 1).alias("next_month"))


@query("fn_strip_ellipsis", "doc_id:l bare:s snippet:s",
       """SELECT doc_id, lang AS bare, CASE WHEN LENGTH(text) > 240 THEN SUBSTR(text, 1, 240) || '…' ELSE text END AS snippet FROM documents""")
def fn_strip_ellipsis(t):
    quoted = F.expr("CASE doc_id % 3 WHEN 0 THEN concat(' \"', lang, '\" ') WHEN 1 THEN concat('''', lang, '''') ELSE lang END")
    return t.documents.select("doc_id", sc.strip_quotes(quoted).alias("bare"), sc.ellipsis(F.col("text")).alias("snippet"))


@query("fn_js_or", "c_custkey:l rate:d label:s from_sql:d",
       """SELECT c_custkey, COALESCE(NULLIF(c_nationkey % 4, 0), 150) AS rate, CASE WHEN c_custkey % 3 = 0 THEN 'Untitled' ELSE c_name END AS label,
 COALESCE(NULLIF(c_nationkey % 4, 0), 150) AS from_sql FROM customer""")
def fn_js_or(t):
    register_sql_functions(t.spark)
    text = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).when(F.col("c_custkey") % 2 == 0, F.lit(""))
    return t.customer.select("c_custkey", sc.js_or(F.col("c_nationkey") % 4, 150).alias("rate"), sc.js_or(text, "Untitled").alias("label"),
                             F.expr("js_or(c_nationkey % 4, 150)").alias("from_sql"))


@query("fn_json_path", "event_id:l k:l row_json:s",
       """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"'
 || event_type || '"}' AS row_json FROM events""")
def fn_json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                           F.to_json(F.struct("event_id", "user_id", "event_type")).alias("row_json"))


@query("fn_arrays", "o_orderkey:l first_word:s long_words:s has_low:b",
       """SELECT o_orderkey, SPLIT_PART(o_orderpriority, '-', 1) AS first_word,
 ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_FILTER(STRING_SPLIT(REPLACE(o_orderpriority, '-', ' '), ' '), lambda w: LENGTH(w) > 2))), ',') AS long_words,
 o_orderpriority LIKE '%LOW%' AS has_low FROM orders""")
def fn_arrays(t):
    words = F.split("o_orderpriority", "[- ]")
    return t.orders.select("o_orderkey", F.get(words, F.lit(0)).alias("first_word"), F.array_join(
        F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))), ",").alias("long_words"),
        F.array_contains(words, "LOW").alias("has_low"))


@query("fn_format", "c_custkey:l shown:s",
       "SELECT c_custkey, FORMAT('{:,}', CAST(TRUNC(ABS(CAST(c_acctbal AS DECIMAL(12,2))) * 1000) AS BIGINT)) AS shown FROM customer")
def fn_format(t):
    # presentation only: thousands separators on whole thousandths
    return t.customer.select("c_custkey", F.format_number((F.abs(F.col("c_acctbal").cast("decimal(12,2)")) * 1000).cast("bigint"), 0).alias("shown"))
