from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import pages as pg
from tallymark.operators.tree import tree_expand
from tallymark.plans.charts import chart
from tallymark.plans.semantic import Dataset, Field
from tallymark.registry.core import query

CANON = (r"""LOWER(REGEXP_EXTRACT(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || REGEXP_REPLACE(REGEXP_EXTRACT(url,"""
         r""" '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')""")
CANON_CTE = f"canon AS (SELECT page_id, html, {CANON} AS canonical_url FROM pages)"
TREE_CTE = CANON_CTE + r""",
split AS (SELECT DISTINCT REGEXP_EXTRACT(canonical_url, '://([^/]*)', 1) AS host,
 LIST_FILTER(STRING_SPLIT(REGEXP_EXTRACT(canonical_url, '://[^/]*(.*)$', 1), '/'), lambda s: s <> '') AS seg FROM canon),
steps AS (SELECT host, seg, UNNEST(RANGE(0, len(seg) + 1)) AS depth FROM split),
trails AS (SELECT DISTINCT host, CAST(depth AS INT) AS depth, [host] || seg[1:depth] AS trail FROM steps),
nodes AS (SELECT ARRAY_TO_STRING(trail, '/') AS id, CASE WHEN depth > 0 THEN ARRAY_TO_STRING(trail[1:depth], '/') END AS parent_id,
 depth, trail[-1] AS title, ARRAY_TO_STRING(trail, ' > ') AS breadcrumb, host AS site_id FROM trails),
typed AS (SELECT n.*, CASE WHEN depth = 0 THEN 'index' WHEN EXISTS (SELECT 1 FROM nodes k WHERE k.parent_id = n.id) THEN 'category'
 ELSE 'leaf' END AS page_type FROM nodes n)"""


@query("page_canonicalize", "page_id:l canonical_url:s node_id:s content_hash:s",
       "SELECT *, SUBSTR(SHA256(canonical_url), 1, 16) AS node_id, SHA256(html) AS content_hash FROM canon", "", CANON_CTE)
def page_canonicalize(t):
    return pg.page_canonicalize(t.pages)


@query("page_dedupe", "page_id:l canonical_url:s content_hash:s removed:l",
       """SELECT MIN(page_id) AS page_id, canonical_url, SHA256(html) AS content_hash, COUNT(*) - 1 AS removed FROM canon
 GROUP BY canonical_url, SHA256(html)""", "", CANON_CTE)
def page_dedupe(t):
    return pg.page_dedupe(t.pages)


@query("document_dedupe", "doc_id:l content_hash:s removed:l",
       "SELECT MIN(doc_id) AS doc_id, SHA256(text) AS content_hash, COUNT(*) - 1 AS removed FROM documents GROUP BY SHA256(text)")
def document_dedupe(t):
    return pg.text_dedupe(t.documents)


@query("page_tree", "id:s parent_id:s depth:l title:s breadcrumb:s page_type:s site_id:s", "SELECT * FROM typed", "", TREE_CTE)
def page_tree(t):
    return pg.page_tree(t.pages)


@query("crawl_stats", "site_id:s pages_discovered:l duplicates_removed:l leaves:l",
       """SELECT s.*, COALESCE(l.n, 0) AS leaves FROM (SELECT REGEXP_EXTRACT(canonical_url, '://([^/]*)', 1) AS site_id,
 COUNT(*) AS pages_discovered, COUNT(*) - COUNT(DISTINCT canonical_url) AS duplicates_removed FROM canon GROUP BY 1) s
 LEFT JOIN (SELECT site_id, COUNT(*) AS n FROM typed WHERE page_type = 'leaf' GROUP BY 1) l ON l.site_id = s.site_id""", "", TREE_CTE)
def crawl_stats(t):
    return pg.crawl_stats(t.pages)


@query("tree_expand", "id:s parent_id:s depth:l stated_depth:l path:s subtree_size:l is_leaf:b is_orphan:b is_cycle:b",
       """SELECT k.id, k.parent_id, w.depth, k.depth AS stated_depth, w.path, (SELECT COUNT(*) FROM down x WHERE x.root = k.id) AS subtree_size,
 NOT EXISTS (SELECT 1 FROM moved z WHERE z.parent_id = k.id) AS is_leaf, k.parent_id IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM moved z WHERE z.id = k.parent_id) AS is_orphan, false AS is_cycle FROM moved k JOIN walk w ON w.id = k.id""", "",
       TREE_CTE + """,
moved AS (SELECT * REPLACE (CASE WHEN title = 'fr' THEN id || '#moved' ELSE id END AS id) FROM nodes),
walk AS (SELECT id, 0 AS depth, CAST(title AS VARCHAR) AS path FROM moved k WHERE parent_id IS NULL
   OR NOT EXISTS (SELECT 1 FROM moved z WHERE z.id = k.parent_id)
 UNION ALL SELECT k.id, w.depth + 1, w.path || ' > ' || k.title FROM moved k JOIN walk w ON k.parent_id = w.id),
down AS (SELECT id AS root, id FROM moved UNION ALL SELECT d.root, k.id FROM moved k JOIN down d ON k.parent_id = d.id)""")
def expand(t):
    # the 'fr' category nodes get another id, so their pages are orphans
    nodes = pg.page_tree(t.pages).withColumn("id", F.when(F.col("title") == "fr", F.concat("id", F.lit("#moved"))).otherwise(F.col("id")))
    stated = nodes.select("id", F.col("depth").alias("stated_depth"))
    return tree_expand(nodes, label="title").join(stated, "id")


@query("content_change", "page_id:l change:s",
       """SELECT page_id, CASE WHEN url LIKE '%/de/%' THEN 'removed' ELSE 'changed' END AS change FROM pages
 WHERE url LIKE '%/de/%' OR url LIKE '%/es/%' UNION ALL SELECT -1 - page_id, 'added' FROM pages WHERE url LIKE '%/de/%'""")
def content_change(t):
    later = (t.pages.withColumn("page_id", F.expr("CASE WHEN url LIKE '%/de/%' THEN -1 - page_id ELSE page_id END"))
             .withColumn("html", F.expr("CASE WHEN url LIKE '%/es/%' THEN CONCAT(html, ' ') ELSE html END")))
    return pg.content_change(t.pages, later)


LINK_SQL = """SELECT page_id, canonical_url AS source, UNNEST(REGEXP_EXTRACT_ALL(html, 'href="([^"]+)"', 1)) AS target FROM canon"""


@query("link_edges", "page_id:l source:s target:s", LINK_SQL, "", CANON_CTE)
def link_edges(t):
    return pg.link_edges(t.pages)


@query("chart_graph", "source:s target:s weight:l source_out_degree:l target_in_degree:l",
       """SELECT source, target, weight, COUNT(*) OVER (PARTITION BY source) AS source_out_degree,
 COUNT(*) OVER (PARTITION BY target) AS target_in_degree FROM (SELECT source, target, COUNT(*) AS weight FROM links GROUP BY 1, 2) z""",
       "", f"{CANON_CTE}, links AS ({LINK_SQL})")
def chart_graph(t):
    data = Dataset(lambda names: pg.link_edges(t.pages), {"source": Field("VARCHAR"), "target": Field("VARCHAR")})
    return chart(data, "graph", source="source", target="target")
