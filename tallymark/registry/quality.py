from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import quality as q
from tallymark.registry.core import query
from tallymark.sources.payloads import SCHEMA_VERSIONS

RULE = "rule:s key:s detail:s"


@query("q_domain", RULE,
       """SELECT 'domain:workflow_type' AS rule, CAST(event_id AS VARCHAR) AS key, workflow_type AS detail FROM workflow_events
 WHERE workflow_type = 'unknown_flow'""", "workflow_events")
def q_domain(t):
    return q.q_domain(t.view("workflow_events"), "workflow_type", q.WORKFLOW_TYPES, ["event_id"])


@query("q_unique", RULE,
       """SELECT 'unique:l_orderkey,l_linenumber' AS rule, l_orderkey || '|' || l_linenumber AS key, COUNT(*) AS detail FROM lineitem
 GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def q_unique(t):
    return q.q_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("q_not_null", RULE,
       """SELECT 'not_null' AS rule, resource_id || '|' || week_of AS key, 'resource_name' AS detail FROM capacity WHERE resource_name IS NULL
 UNION ALL SELECT 'not_null', resource_id || '|' || week_of, 'resource_email' FROM capacity WHERE resource_email IS NULL""", "capacity")
def q_not_null(t):
    return q.q_not_null(t.view("capacity"), ["company_id", "resource_name", "resource_email"], ["resource_id", "week_of"])


@query("q_date_order", RULE,
       """SELECT 'date_order:date_start,date_end' AS rule, CAST(portfolio_id AS VARCHAR) AS key, date_start || ' > ' || date_end AS detail
 FROM portfolios WHERE date_start > date_end""", "portfolios")
def q_date_order(t):
    return q.q_date_order(t.view("portfolios"), "date_start", "date_end", ["portfolio_id"])


_TYPES = " UNION ALL ".join(f"SELECT '{k}' AS asset_type, '{v}' AS field" for k, f in q.REQUIRED_FIELDS.items() for v in f)
_EXPECTED = "CASE asset_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SCHEMA_VERSIONS.items()) + " END"
BUNDLE_CTE = f"""req AS ({_TYPES}), parsed AS (SELECT asset_type, file, CAST(doc AS JSON) AS j FROM bundle_docs),
obj AS (SELECT *, j->>'$.version' AS v, j->>'$.schema_version' AS sv, {_EXPECTED} AS want FROM parsed WHERE json_type(j) = 'OBJECT'),
bad AS (SELECT asset_type, file, 'root' AS error_kind, 'Root must be a dictionary' AS message FROM parsed WHERE json_type(j) <> 'OBJECT'
 UNION ALL SELECT o.asset_type, file, 'missing_field', 'Missing required field: ' || field FROM obj o JOIN req r ON r.asset_type = o.asset_type
   WHERE NOT list_contains(json_keys(j), field)
 UNION ALL SELECT asset_type, file, 'version', 'Unsupported version: ' || v || ' (supported: 1.0)' FROM obj WHERE v <> '' AND v <> '1.0'
 UNION ALL SELECT asset_type, file, 'schema_version', 'Invalid schema_version: expected ' || want || ', got ' || sv FROM obj
   WHERE sv <> '' AND sv <> want)"""


@query("bundle_validate", "asset_type:s file:s error_kind:s message:s", "SELECT * FROM bad", "bundle_docs", BUNDLE_CTE)
def bundle_validate(t):
    return q.bundle_validate(t.view("bundle_docs"))


@query("validation_summary", "asset_type:s total:l valid:l n_errors:l",
       """SELECT d.asset_type, COUNT(*) AS total, COUNT(*) FILTER (WHERE n IS NULL) AS valid, COALESCE(SUM(n), 0) AS n_errors
 FROM bundle_docs d LEFT JOIN (SELECT asset_type, file, COUNT(*) AS n FROM bad GROUP BY 1, 2) b
 ON b.asset_type = d.asset_type AND b.file = d.file GROUP BY 1""", "bundle_docs", BUNDLE_CTE)
def validation_summary(t):
    return q.validation_summary(t.view("bundle_docs"))


DRIFT_SQL = """SELECT COALESCE(b.asset_type, r.asset_type) AS asset_type, COALESCE(b.name, r.name) AS name,
 CASE WHEN b.name IS NULL THEN 'added' WHEN r.name IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM assets_bundle b FULL JOIN assets_runtime r ON b.asset_type = r.asset_type AND b.name = r.name
 WHERE b.content IS DISTINCT FROM r.content"""


@query("drift_diff", "asset_type:s name:s change:s", DRIFT_SQL, "assets_bundle assets_runtime")
def drift_diff(t):
    return q.drift_diff(t.view("assets_bundle"), t.view("assets_runtime"), ["asset_type", "name"])


@query("drift_gate", "environment:s n_changes:l status:s gate:s",
       f"""SELECT environment, n_changes, CASE WHEN n_changes > 0 THEN 'DRIFT_FOUND' ELSE 'NO_DRIFT' END AS status,
 CASE WHEN n_changes = 0 THEN 'pass' WHEN environment IN ('staging', 'prod') THEN 'fail' ELSE 'warn' END AS gate FROM
 (SELECT CASE b.asset_type WHEN 'database' THEN 'dev' WHEN 'dataset' THEN 'staging' WHEN 'chart' THEN 'prod' ELSE 'qa' END AS environment,
  COUNT(d.change) AS n_changes FROM assets_bundle b LEFT JOIN ({DRIFT_SQL}) d ON d.name = b.name GROUP BY 1) z""",
       "assets_bundle assets_runtime")
def drift_gate(t):
    bundle = t.view("assets_bundle")
    drift = q.drift_diff(bundle, t.view("assets_runtime"), ["asset_type", "name"])
    env = F.expr("CASE asset_type WHEN 'database' THEN 'dev' WHEN 'dataset' THEN 'staging' WHEN 'chart' THEN 'prod' ELSE 'qa' END")
    placed = bundle.select("asset_type", "name", env.alias("environment")).join(drift, ["asset_type", "name"], "left")
    return q.drift_gate(placed)


@query("expected_datasets", "name:s",
       "SELECT name FROM (VALUES ('src0'), ('src1'), ('src2'), ('src98'), ('src99')) v(name) WHERE name NOT IN (SELECT source FROM documents)")
def expected_datasets(t):
    expected = t.spark.createDataFrame([(n,) for n in ("src0", "src1", "src2", "src98", "src99")], "name string")
    return q.expected_datasets(expected, t.documents.select(F.col("source").alias("name")))


@query("template_tokenize", "name:s body:s",
       r"""SELECT name, REPLACE(REPLACE(REPLACE(REGEXP_REPLACE(body, '\b(dev|staging|prod)\b', '{{ ENV }}', 'gi'),
 'db-{{ ENV }}.example.com', '{{ DB_HOST }}'), 'analytics_dev', '{{ DB_NAME }}'), '"public"', '"{{ SCHEMA }}"') AS body FROM asset_texts""",
       "asset_texts")
def template_tokenize(t):
    rules = [(r"db-\{\{ ENV \}\}\.example\.com", "{{ DB_HOST }}"), ("analytics_dev", "{{ DB_NAME }}"), ('"public"', '"{{ SCHEMA }}"')]
    return q.template_tokenize(t.view("asset_texts"), "body", rules)


@query("deploy_stats", "environment:s total:l success:l failed:l running:l avg_seconds:d assets:l",
       """SELECT environment, COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'success') AS success,
 COUNT(*) FILTER (WHERE status = 'failed') AS failed, COUNT(*) FILTER (WHERE status = 'running') AS running,
 CAST(SUM(seconds) AS DOUBLE) / COUNT(seconds) AS avg_seconds, SUM(n_assets) AS assets FROM deploys GROUP BY 1""", "deploys")
def deploy_stats(t):
    return q.deploy_stats(t.view("deploys"))
