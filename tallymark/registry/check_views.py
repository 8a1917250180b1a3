"""The input views of ``sources.views`` as plain SQL for the checking engine.

Written row by row (no folding before the joins), so they also check that the
pre-aggregated Spark views give the same rows.
"""

from __future__ import annotations

from tallymark.sources import payloads

_PRICE = "CAST(l.l_extendedprice AS DECIMAL(12,2))"
_DISC = "CAST(l.l_discount AS DECIMAL(4,2))"
_TAX = "CAST(l.l_tax AS DECIMAL(4,2))"
_MONTH = "CAST(DATE_TRUNC('month', o.o_orderdate) AS DATE)"
_STATE = "CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'draft' ELSE 'cancel' END"

CHECK_VIEWS = {
    "fact_sales": f"""
SELECT l.l_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS order_date, o.o_custkey AS customer_id,
  c.c_mktsegment AS segment, n.n_name AS nation, r.r_name AS region, p.p_brand AS brand, p.p_type AS category,
  p.p_name AS product_name, l.l_returnflag AS channel, CAST(l.l_quantity AS DECIMAL(12,2)) AS quantity,
  {_PRICE} * (1 - {_DISC}) AS revenue, {_PRICE} * (CAST(0.30 AS DECIMAL(4,2)) - {_DISC}) AS profit
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey""",
    "evm": f"""
SELECT c.c_nationkey AS company_id, c.c_custkey AS project_id, MAX(c.c_name) AS project_name, {_MONTH} AS calculation_date,
  CAST(SUM({_PRICE} * 2) AS DECIMAL(20,2)) AS bac, CAST(SUM({_PRICE} * (1 - {_DISC})) AS DECIMAL(20,2)) AS pv,
  CAST(SUM({_PRICE} * (1 - 2 * {_TAX})) AS DECIMAL(20,2)) AS ev,
  CAST(SUM(CASE WHEN c.c_custkey % 40 = 0 THEN CAST(0 AS DECIMAL(12,2)) ELSE {_PRICE} END
    * (1 + {_DISC} - 2 * {_TAX})) AS DECIMAL(20,2)) AS ac
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY c.c_nationkey, c.c_custkey, {_MONTH}""",
    "budget": f"""
SELECT c.c_nationkey AS company_id, c.c_custkey AS project_id, MAX(c.c_name) AS project_name, {_MONTH} AS snapshot_date,
  CAST(CASE WHEN c.c_custkey % 30 = 0 THEN 0 ELSE SUM({_PRICE}) FILTER (WHERE o.o_orderstatus <> 'P') END AS DECIMAL(20,2)) AS planned_amount,
  CAST(SUM({_PRICE} * (1 + 5 * {_TAX} - 4 * {_DISC})) AS DECIMAL(20,2)) AS actual_amount, MIN(o.o_orderkey) AS first_order
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY c.c_nationkey, c.c_custkey, {_MONTH}""",
    "capacity": """
SELECT user_id % 5 AS company_id, user_id AS resource_id,
  CASE WHEN user_id % 17 = 0 THEN NULL ELSE CONCAT('user_', CAST(user_id % 100 AS VARCHAR)) END AS resource_name,
  CASE WHEN user_id % 19 = 0 OR user_id % 17 = 0 THEN NULL ELSE CONCAT('user_', CAST(user_id % 100 AS VARCHAR), '@example.com')
    END AS resource_email,
  CAST(DATE_TRUNC('week', ts) AS DATE) AS week_of,
  CAST(CASE WHEN user_id % 25 = 0 THEN 0 ELSE 40 END AS DECIMAL(20,2)) AS available_hours,
  CAST(SUM(CAST(value AS DECIMAL(10,2)) * CAST(0.1 AS DECIMAL(2,1))) AS DECIMAL(20,2)) AS allocated_hours,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(10,2)) ELSE CAST(0 AS DECIMAL(10,2)) END
    * CAST(0.1 AS DECIMAL(2,1))) AS DECIMAL(20,2)) AS billable_hours
FROM events GROUP BY user_id, CAST(DATE_TRUNC('week', ts) AS DATE)""",
    "sla": """
SELECT c.c_nationkey AS company_id, o.o_orderkey AS clearance_request_id, o.o_custkey AS employee_id,
  c.c_name AS employee_name, c.c_mktsegment AS department, CAST(o.o_orderdate AS DATE) AS last_working_date,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(MIN(l.l_shipdate) AS DATE) END AS clearance_date,
  CASE WHEN o.o_orderstatus = 'O' THEN NULL ELSE CAST(MIN(l.l_shipdate) AS DATE) + CAST(o.o_orderkey % 13 AS INT) END
    AS final_pay_executed_date
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY c.c_nationkey, o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment, o.o_orderdate, o.o_orderstatus""",
    "checklist": """
SELECT c.c_nationkey AS company_id, l.l_orderkey AS clearance_request_id,
  CASE l.l_returnflag WHEN 'A' THEN 'IT' WHEN 'N' THEN 'Finance' ELSE 'HR' END AS department,
  l.l_linenumber AS checklist_item, l.l_linestatus = 'F' AS is_cleared
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""",
    "timesheet": """
SELECT l.l_orderkey * 10 + l.l_linenumber AS id, o.o_custkey AS project_id, l.l_suppkey AS employee_id,
  s.s_name AS employee_name, CONCAT('s', CAST(l.l_suppkey AS VARCHAR), '@example.com') AS employee_email,
  CAST(l.l_quantity AS DECIMAL(10,2)) AS unit_amount, CAST(l.l_shipdate AS DATE) AS work_date,
  l.l_returnflag = 'A' AS is_invoiced
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "rates": """
SELECT CONCAT('s', CAST(s_suppkey AS VARCHAR), '@example.com') AS email, s_name AS name,
  CASE WHEN s_acctbal > 0 THEN CAST(s_acctbal AS DECIMAL(10,2)) END AS hourly_rate FROM supplier""",
    "billing_config": """
SELECT c_custkey AS project_id, CASE WHEN c_custkey % 4 = 0 THEN 'fixed' ELSE 'tm' END AS billing_type,
  CAST((c_custkey % 3) * 75 AS DECIMAL(10,2)) AS base_rate, CAST((c_custkey % 5) * 5 AS DECIMAL(5,2)) AS markup_percentage
FROM customer""",
    "portfolios": """
SELECT s_suppkey AS portfolio_id, s_name AS name, s_suppkey % 4 AS priority, (s_suppkey * 37) % 101 AS strategic_alignment,
  (s_suppkey * 53) % 101 AS business_value, (s_suppkey * 71) % 101 AS risk_level,
  (s_suppkey * 89) % 101 AS resource_availability, CAST(40000 + 20000 * (s_suppkey % 5) AS DECIMAL(20,2)) AS budget_total,
  CASE s_suppkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' ELSE 'on_hold' END AS state,
  CASE s_suppkey % 7 WHEN 0 THEN 'On Hold' WHEN 1 THEN 'Approved' WHEN 2 THEN 'Parked' WHEN 3 THEN ''
    WHEN 4 THEN NULL WHEN 5 THEN 'Closed' ELSE 'Submitted' END AS status_label,
  CASE WHEN s_suppkey % 3 <> 0 THEN CONCAT('acc_', CAST(s_suppkey AS VARCHAR)) END AS account_id,
  DATE '2024-01-01' + CAST(s_suppkey % 60 AS INT) AS date_start,
  CASE WHEN s_suppkey % 9 <> 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 45 AS INT) END AS date_end FROM supplier""",
    "projects": """
SELECT c_custkey AS project_id, c_custkey // 15 AS portfolio_id, c_name AS name,
  CAST(ABS(CAST(c_acctbal AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS budget_total,
  CASE WHEN c_custkey % 3 <> 0 THEN CONCAT('acc_p', CAST(c_custkey AS VARCHAR)) END AS account_id FROM customer""",
    "ledger": f"""
SELECT o.o_custkey AS project_id, l.l_orderkey * 10 + l.l_linenumber AS line_id,
  CASE WHEN l.l_linestatus = 'F' THEN -{_PRICE} ELSE {_PRICE} END AS amount
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "assets_bundle": f"""
SELECT {payloads.ASSET_TYPE} AS asset_type, CONCAT(CASE WHEN p_brand = 'Brand#7' THEN 'old_' ELSE 'asset_' END, CAST(p_partkey AS VARCHAR)) AS name,
  {payloads.ASSET_CONTENT.format(size='p_size')} AS content FROM part""",
    "assets_runtime": f"""
SELECT {payloads.ASSET_TYPE} AS asset_type, CONCAT(CASE WHEN p_brand = 'Brand#13' THEN 'new_' ELSE 'asset_' END, CAST(p_partkey AS VARCHAR)) AS name,
  {payloads.ASSET_CONTENT.format(size='CASE WHEN p_size = 10 THEN p_size + 1 ELSE p_size END')} AS content
FROM part""",
    "bundle_docs": f"""
SELECT {payloads.BUNDLE_TYPE} AS asset_type, CONCAT('f', CAST(p_partkey AS VARCHAR), '.yaml') AS file,
  {payloads.BUNDLE_DOC} AS doc FROM part""",
    "asset_texts": """
SELECT CONCAT('asset_', CAST(p_partkey AS VARCHAR)) AS name,
  CONCAT('host: db-', CASE p_partkey % 3 WHEN 0 THEN 'Dev' WHEN 1 THEN 'staging' ELSE 'PROD' END,
  '.example.com schema: "public" db: analytics_dev note: developer ', p_name) AS body FROM part""",
    "deploys": """
SELECT o_orderkey AS deployment_id, CASE o_orderkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'staging' ELSE 'prod' END AS environment,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN o_orderstatus <> 'P' THEN 30 + o_orderkey % 600 END AS seconds, 1 + o_orderkey % 35 AS n_assets FROM orders""",
    "skills": """
SELECT o.o_custkey AS resource_id, p.p_brand AS skill
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "tree": """
SELECT CONCAT('R', CAST(r_regionkey AS VARCHAR)) AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS label FROM region
UNION ALL SELECT CONCAT('N', CAST(n_nationkey AS VARCHAR)), CONCAT('R', CAST(n_regionkey AS VARCHAR)), n_name FROM nation
UNION ALL SELECT CONCAT('C', CAST(c_custkey AS VARCHAR)), CONCAT('N', CAST(c_nationkey AS VARCHAR)), c_name FROM customer""",
    "names": """
SELECT l.l_linestatus AS state, YEAR(l.l_shipdate) AS year, l.l_returnflag AS gender, p.p_name AS name, COUNT(*) AS num
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 3, 4""",
    "intake": f"SELECT CAST({payloads.INTAKE_PAYLOAD} AS JSON) AS p FROM customer",
    "ocr": f"SELECT o_orderkey AS doc_id, CAST({payloads.OCR_PAYLOAD} AS JSON) AS p FROM orders",
    "invoices": f"""
SELECT o_orderkey AS invoice_id, o_custkey AS partner_id, {_STATE} AS state,
  CAST(o_totalprice AS DECIMAL(12,2)) AS amount_total, CAST(o_orderdate AS DATE) AS invoice_date,
  CAST(o_orderdate AS DATE) + 30 AS due_date FROM orders""",
    "clearance_events": """
SELECT user_id % 5 AS company_id, user_id AS clearance_request_id, event_id, ts AS created_at,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'department_cleared'
  WHEN 'purchase' THEN 'clearance_complete' ELSE 'final_pay_executed' END AS event_type,
  CAST(value AS DECIMAL(12,2)) AS gross_pay FROM events""",
    "workflow_events": """
SELECT event_id, user_id % 5 AS company_id, CASE event_type WHEN 'purchase' THEN 'invoice_generation'
  WHEN 'signup' THEN 'portfolio_intake' WHEN 'click' THEN 'task_sync' WHEN 'view' THEN 'capacity_sync'
  ELSE 'unknown_flow' END AS workflow_type,
  CASE user_id % 3 WHEN 0 THEN 'notion' WHEN 1 THEN 'odoo' ELSE 'n8n' END AS source_system,
  CAST(user_id AS VARCHAR) AS source_record_id, 'created' AS action, props, ts AS created_at FROM events""",
    "drift_log": """
SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'staging' ELSE 'prod' END AS environment,
  CASE event_type WHEN 'error' THEN 'drift_found' ELSE 'clean' END AS status, props AS diff_output, ts AS checked_at FROM events""",
    "commands": f"""
SELECT event_id, {payloads.COMMAND_TEXT} AS command,
  CASE user_id % 4 WHEN 0 THEN 'advisory' WHEN 1 THEN 'warning' WHEN 2 THEN 'confirmation' ELSE 'strict' END AS level,
  CASE WHEN value > 60 THEN 'shell' WHEN value > 30 THEN 'builtin' ELSE 'mcp' END AS tool_kind,
  value > 100 AS fallback_used, event_type = 'error' AS failed,
  CAST(CAST(value AS DECIMAL(10,2)) * 100 AS BIGINT) AS detect_us,
  CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'before' ELSE 'after' END AS phase FROM events""",
    "corpus": f"""
SELECT doc_id, source, lang, {payloads.CORPUS_PATH} AS path, CONCAT(text, CHR(10), {payloads.CORPUS_BLOCK}) AS text,
  text AS body FROM documents""",
    "parity": """
SELECT CONCAT('cap_', CAST(p_partkey AS VARCHAR)) AS capability_id, p_name AS capability_name,
  CASE p_type WHEN 'STANDARD' THEN 'PPM' WHEN 'MEDIUM' THEN 'HR' WHEN 'PROMO' THEN 'Ops'
    WHEN 'LARGE' THEN 'Analytics' ELSE 'Finance' END AS domain,
  [CONCAT('page_', CAST(p_partkey * 3 AS VARCHAR)), CONCAT('doc:', p_brand)] AS enterprise_refs,
  p_size % 3 < 2 AS in_core, CASE WHEN p_size BETWEEN 13 AND 25 THEN p_brand END AS repo,
  CASE WHEN p_size BETWEEN 13 AND 25 THEN CONCAT('module_', p_name) END AS module,
  p_size % 5 = 0 AS has_alt, p_size % 2 = 0 AS settings_only, p_partkey % 2 = 0 AS reusable, p_size >= 45 AS erp_unsafe,
  CASE WHEN p_partkey % 6 <> 0 THEN CONCAT('needs ', p_name) END AS justification, p_size % 4 AS gap_level,
  CASE WHEN p_brand = 'Brand#9' THEN 'Minimal Custom' WHEN p_size % 4 = 0 THEN 'Config' WHEN p_size % 4 = 1 THEN 'OCA'
    WHEN p_size % 4 = 2 THEN 'Minimal Custom' ELSE 'External' END AS smart_delta FROM part""",
    "registry_entries": """
SELECT DISTINCT p_brand AS repo, CASE WHEN p_size BETWEEN 13 AND 19 THEN 'module_' || p_name ELSE 'addon_' || p_name END AS module FROM part""",
}
