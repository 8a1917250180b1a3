from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import capability as cap
from tallymark.operators import resolve
from tallymark.plans.chart_catalog import KINDS
from tallymark.registry.core import query

P = "parity"
REFS = "refs AS (SELECT capability_id, UNNEST(enterprise_refs) AS ref FROM parity)"


@query("oca_exists", "capability_id:s",
       """SELECT capability_id FROM parity p WHERE EXISTS (SELECT 1 FROM registry_entries r WHERE r.repo = p.repo AND r.module = p.module)""",
       "parity registry_entries")
def oca_exists(t):
    return cap.oca_exists(t.view(P), t.view("registry_entries"))


@query("gap_classify", "capability_id:s gap_level:l computed_gap:l computed_choice:s",
       """SELECT *, CASE computed_gap WHEN 0 THEN 'Config' WHEN 1 THEN 'OCA' WHEN 2 THEN 'Minimal Custom' WHEN 3 THEN 'External'
 ELSE 'unresolved' END AS computed_choice FROM (SELECT *, CASE WHEN in_core AND settings_only THEN 0 WHEN module IS NOT NULL THEN 1
 WHEN reusable THEN 2 WHEN erp_unsafe THEN 3 END AS computed_gap FROM parity) z""", P)
def gap_classify(t):
    return cap.gap_classify(t.view(P))


GATES_SQL = """SELECT 'no_phantom_custom' AS rule, capability_id AS key, smart_delta AS detail FROM parity
 WHERE smart_delta LIKE '%Custom%' AND gap_level < 2
UNION ALL SELECT 'oca_ref_required', capability_id, 'no module' FROM parity WHERE gap_level = 1 AND module IS NULL
UNION ALL SELECT 'external_justification', capability_id, 'no justification' FROM parity WHERE gap_level = 3 AND COALESCE(justification, '') = ''
UNION ALL SELECT 'label_mismatch', capability_id, smart_delta FROM parity WHERE smart_delta <>
 CASE gap_level WHEN 0 THEN 'Config' WHEN 1 THEN 'OCA' WHEN 2 THEN 'Minimal Custom' ELSE 'External' END"""


@query("parity_gates", "rule:s key:s detail:s", GATES_SQL, P)
def parity_gates(t):
    return cap.parity_gates(t.view(P))


def leaf_nodes(t):
    return t.pages.selectExpr("CONCAT('page_', page_id) AS id", "url", "url LIKE '%/de/%' AS out_of_scope")


@query("unmapped_capabilities", "id:s url:s",
       """SELECT 'page_' || page_id AS id, url FROM pages WHERE url NOT LIKE '%/de/%'
 AND 'page_' || page_id NOT IN (SELECT ref FROM refs)""", P, REFS)
def unmapped_capabilities(t):
    return cap.unmapped_capabilities(leaf_nodes(t), t.view(P))


@query("capability_sources", "capability_id:s ref:s url:s",
       "SELECT capability_id, ref, url FROM refs LEFT JOIN pages ON ref = 'page_' || page_id", P, REFS)
def capability_sources(t):
    return cap.capability_sources(t.view(P), leaf_nodes(t))


COVERAGE = """SELECT domain, COUNT(*) AS total, COUNT(*) FILTER (WHERE gap_level = 0) AS gap_0, COUNT(*) FILTER (WHERE gap_level = 1) AS gap_1,
 COUNT(*) FILTER (WHERE gap_level = 2) AS gap_2, COUNT(*) FILTER (WHERE gap_level = 3) AS gap_3,
 CAST(100 * COUNT(*) FILTER (WHERE gap_level <= 1) AS DOUBLE) / COUNT(*) AS parity_pct FROM parity GROUP BY """


@query("parity_coverage", "domain:s total:l gap_0:l gap_1:l gap_2:l gap_3:l parity_pct:d", COVERAGE + "ROLLUP (domain)", P)
def parity_coverage(t):
    return cap.parity_coverage(t.view(P))


@query("coverage_targets", "gap_level:l op:s target:l n:l total:l share_pct:d passed:b",
       """SELECT *, CASE WHEN op = '>' THEN share_pct > target ELSE share_pct < target END AS passed FROM
 (SELECT v.*, (SELECT COUNT(*) FROM parity p WHERE p.gap_level = v.gap_level) AS n, (SELECT COUNT(*) FROM parity) AS total,
  CAST(100 * (SELECT COUNT(*) FROM parity p WHERE p.gap_level = v.gap_level) AS DOUBLE) / (SELECT COUNT(*) FROM parity) AS share_pct
  FROM (VALUES (0, '>', 60), (1, '>', 30), (2, '<', 10), (3, '<', 5)) v(gap_level, op, target)) z""", P)
def coverage_targets(t):
    return cap.coverage_targets(t.view(P))


@query("coverage_mismatch", "domain:s figure:s stated:l computed:l",
       """SELECT domain, 'total' AS figure, total + 1 AS stated, total AS computed FROM cov WHERE domain = 'HR'
 UNION ALL SELECT domain, 'gap_1', gap_1 + 1, gap_1 FROM cov WHERE domain = 'HR'
 UNION ALL SELECT domain, 'gap_2', gap_2 - 1, gap_2 FROM cov WHERE domain = 'Ops'""", P, f"cov AS ({COVERAGE}1)")
def coverage_mismatch(t):
    # the published summary: right except for two domains
    hr, ops = F.when(F.col("domain") == "HR", 1).otherwise(0), F.when(F.col("domain") == "Ops", 1).otherwise(0)
    stated = (cap.parity_coverage(t.view(P)).filter("domain IS NOT NULL")
              .withColumns({"total": F.col("total") + hr, "gap_1": F.col("gap_1") + hr, "gap_2": F.col("gap_2") - ops}))
    return cap.coverage_mismatch(t.view(P), stated)


@query("parity_diff", "capability_id:s change:s",
       """SELECT capability_id, CASE WHEN domain = 'PPM' AND gap_level = 3 THEN 'added' WHEN domain = 'Ops' AND gap_level = 0 THEN 'removed'
 ELSE 'changed' END AS change FROM parity WHERE (domain = 'PPM' AND gap_level = 3) OR (domain = 'Ops' AND gap_level = 0)
 OR (domain = 'HR' AND gap_level = 2)
 UNION ALL SELECT capability_id || '_old', 'removed' FROM parity WHERE domain = 'PPM' AND gap_level = 3
 UNION ALL SELECT capability_id || '_new', 'added' FROM parity WHERE domain = 'Ops' AND gap_level = 0""", P)
def parity_diff(t):
    run = t.view(P)
    renamed = "CASE WHEN {} THEN concat(capability_id, '{}') ELSE capability_id END"
    before = run.withColumn("capability_id", F.expr(renamed.format("domain = 'PPM' AND gap_level = 3", "_old")))
    after = run.withColumn("capability_id", F.expr(renamed.format("domain = 'Ops' AND gap_level = 0", "_new"))).withColumn(
        "gap_level", F.expr("CASE WHEN domain = 'HR' AND gap_level = 2 THEN 1 ELSE gap_level END"))
    return cap.parity_diff(before, after)


@query("determinism_hash", "n:l xor:l total:s",
       """SELECT COUNT(*) AS n, BIT_XOR(d) AS xor, CAST(SUM(CAST(d AS HUGEINT)) AS VARCHAR) AS total FROM
 (SELECT CAST('0x' || SUBSTR(SHA256(CAST(TO_JSON(STRUCT_PACK(capability_id := capability_id, domain := domain, gap_level := gap_level,
  smart_delta := smart_delta, justification := justification)) AS VARCHAR)), 1, 15) AS BIGINT) AS d FROM parity) z""", P)
def determinism_hash(t):
    return cap.determinism_hash(t.view(P), ["capability_id", "domain", "gap_level", "smart_delta", "justification"])


# words of the part names stand in for the page tags of a crawl
TAXONOMY = {"Finance": ["ring", "bolt"], "PPM": ["widget", "small"], "HR": ["gear"], "Ops": ["gizmo", "red"], "Analytics": ["hot", "cold"]}


@query("capability_tag", "capability_id:s domain:s",
       "SELECT capability_id, CASE " + " ".join(
           f"WHEN list_has_any(string_split(capability_name, ' '), {w!r}) THEN '{d}'" for d, w in TAXONOMY.items())
       + " END AS domain FROM parity", P)
def capability_tag(t):
    df = t.view(P).select("capability_id", F.split("capability_name", " ").alias("tags"))
    return cap.capability_tag(df, "tags", TAXONOMY)


@query("feature_request_queue", "id:s title:s justification:s proposed_solution:s references:s gap_level:l preferred_resolution:s status:s",
       """SELECT capability_id AS id, 'Feature Request - ' || capability_name AS title, COALESCE(justification, '') AS justification,
 'Extend existing ' || COALESCE(module, 'new module') AS proposed_solution, ARRAY_TO_STRING(enterprise_refs, ',') AS "references",
 gap_level, CASE gap_level WHEN 1 THEN 'OCA' ELSE 'Custom' END AS preferred_resolution, 'Draft' AS status FROM parity
 WHERE gap_level IN (1, 2)""", P)
def feature_request_queue(t):
    return cap.feature_request_queue(t.view(P))


@query("catalog_union", "id:s url:s catalog:s tag:s",
       """SELECT 'page_' || page_id AS id, url, CASE WHEN url LIKE 'https:%' THEN 'secure' ELSE 'plain' END AS catalog,
 CASE WHEN url LIKE 'https:%' THEN 'tls' END AS tag FROM pages""")
def catalog_union(t):
    nodes = t.pages.selectExpr("CONCAT('page_', page_id) AS id", "url")
    plain = nodes.filter("url IS NULL OR url NOT LIKE 'https:%'").withColumn("catalog", F.lit("plain"))
    secure = nodes.filter("url LIKE 'https:%'").withColumn("catalog", F.lit("secure")).withColumn("tag", F.lit("tls"))
    return cap.catalog_union(plain, secure)


# renderer types an environment may offer; each supplier stands for one environment
TYPES = ["echarts_timeseries_line", "ECharts-Bar", "echarts_pie", "line", "bar", "dist_bar", "pie", "scatter", "heatmap",
         "big_number", "big_number_total", "table", "pivot_table_v2", "treemap_v2", "my_echarts_gauge_x", "world_map",
         "deck_scatter", "box_plot", "histogram", "word_cloud"]


def viz_offered(t):
    df = t.supplier.selectExpr(
        "s_suppkey AS env", f"explode(sequence(CAST(s_suppkey % 5 AS INT), {len(TYPES) - 1}, CAST(1 + s_nationkey % 4 AS INT))) AS i")
    return df.select("env", F.element_at(F.array(*map(F.lit, TYPES)), F.col("i") + 1).alias("viz_type"))


OFFER_CTE = f"""offered AS (SELECT env, viz_type FROM (SELECT s_suppkey AS env, UNNEST(RANGE(s_suppkey % 5, {len(TYPES)}, 1 + s_nationkey % 4)) AS i FROM supplier) z,
 LATERAL (SELECT {TYPES!r}[i + 1] AS viz_type) y)"""
_OPTIONS = ", ".join(f"('{k}', {s}, {i}, '{n}')" for k, spec in KINDS.items() for s, names in enumerate(spec[2:]) for i, n in enumerate(names))


@query("resolve_candidates", "env:l kind:s viz_type:s how:s",
       """SELECT q.env, q.kind, COALESCE(h.viz_type, d.candidate) AS viz_type, CASE WHEN h.viz_type IS NULL THEN 'default'
 WHEN h.fuzzy = 0 THEN 'exact' ELSE 'fuzzy' END AS how FROM (SELECT DISTINCT s_suppkey AS env, kind FROM supplier, options) q
 LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY env, kind ORDER BY stage, fuzzy, pos, viz_type) AS rn FROM matched) m
  WHERE rn = 1) h ON h.env = q.env AND h.kind = q.kind LEFT JOIN options d ON d.kind = q.kind AND d.stage = 1 AND d.pos = 0""", "",
       OFFER_CTE + f""", options AS (SELECT * FROM (VALUES {_OPTIONS}) v(kind, stage, pos, candidate)),
matched AS (SELECT env, kind, stage, pos, viz_type, CASE WHEN viz_type = candidate THEN 0 ELSE 1 END AS fuzzy FROM offered, options
 WHERE viz_type = candidate OR REGEXP_MATCHES(viz_type, REGEXP_REPLACE(candidate, '[_-]+', '.*', 'g'), 'i'))""")
def resolve_candidates(t):
    kinds = F.explode(F.array(*[F.lit(k) for k in KINDS]))
    requests = t.supplier.select(F.col("s_suppkey").alias("env"), kinds.alias("kind"))
    return resolve.resolve_candidates(requests, viz_offered(t), "env")


@query("viz_type_counts", "count:l echarts_count:l classic_count:l",
       """SELECT COUNT(*) AS count, COUNT(*) FILTER (WHERE viz_type LIKE 'echarts%') AS echarts_count,
 COUNT(*) FILTER (WHERE viz_type NOT LIKE 'echarts%') AS classic_count FROM (SELECT DISTINCT viz_type FROM offered) z""", "", OFFER_CTE)
def viz_type_counts(t):
    return resolve.viz_type_counts(viz_offered(t))
