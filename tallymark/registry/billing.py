from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallymark.operators import billing as bl
from tallymark.registry.core import query

AS_OF = dt.date(1997, 6, 15)
START, END = dt.date(1996, 1, 1), dt.date(1998, 12, 31)
TERMS = """terms AS (SELECT project_id, billing_type, CASE WHEN base_rate = 0 THEN 150 ELSE base_rate END AS base_rate,
 CASE WHEN markup_percentage = 0 THEN 15 ELSE markup_percentage END AS markup FROM billing_config),
open_ts AS (SELECT * FROM timesheet WHERE NOT is_invoiced AND work_date >= DATE '1996-01-01' AND work_date <= DATE '1998-12-31')"""


def _lines_sql(key: str) -> str:
    return f"""lines AS (SELECT e.project_id, e.employee_id, MIN(e.employee_name) AS employee_name,
 'Labor - ' || MIN(e.employee_name) AS name, SUM(e.unit_amount) AS quantity,
 CAST(COALESCE(MIN(r.hourly_rate), MIN(t.base_rate)) AS DECIMAL(12,2)) * (100 + MIN(t.markup)) * CAST(0.01 AS DECIMAL(3,2)) AS price_unit,
 COUNT(*) AS n_entries FROM open_ts e JOIN terms t ON t.project_id = e.project_id AND t.billing_type = 'tm'
 LEFT JOIN rates r ON r.email = e.{key} AND r.hourly_rate <> 0 GROUP BY 1, 2)"""


VIEWS = "timesheet rates billing_config"


@query("rate_lookup", "id:l project_id:l employee_name:s rate:d",
       """SELECT e.id, e.project_id, e.employee_name, COALESCE(r.hourly_rate, t.base_rate) AS rate FROM timesheet e
 JOIN terms t ON t.project_id = e.project_id LEFT JOIN rates r ON r.email = e.employee_email AND r.hourly_rate <> 0""", VIEWS, TERMS)
def rate_lookup(t):
    rows = bl.with_terms(t.view("timesheet"), t.view("billing_config"))
    return bl.rate_lookup(rows, t.view("rates"), rate_key="employee_email")


LINE_SPEC = "project_id:l employee_id:l employee_name:s name:s quantity:d price_unit:d subtotal:d n_entries:l"


def _lines(t, **options):
    return bl.tm_invoice_lines(t.view("timesheet"), t.view("billing_config"), t.view("rates"), START, END, **options)


@query("tm_invoice_lines", LINE_SPEC, "SELECT *, quantity * price_unit AS subtotal FROM lines", VIEWS,
       f"{TERMS}, {_lines_sql('employee_name')}")
def tm_invoice_lines(t):
    return _lines(t)


@query("tm_invoice_lines_by_email", LINE_SPEC, "SELECT *, quantity * price_unit AS subtotal FROM lines", VIEWS,
       f"{TERMS}, {_lines_sql('employee_email')}")
def tm_invoice_lines_by_email(t):
    return _lines(t, rate_key="employee_email")


@query("tm_invoice_total", "project_id:l billing_type:s total:d n_lines:l message:s",
       f"""SELECT t.project_id, t.billing_type, CASE WHEN t.billing_type = 'tm' THEN COALESCE(x.total, 0) END AS total,
 CASE WHEN t.billing_type = 'tm' THEN COALESCE(x.n, 0) END AS n_lines,
 CASE WHEN t.billing_type <> 'tm' THEN '{bl.FIXED_MESSAGE}' END AS message FROM terms t LEFT JOIN
 (SELECT project_id, SUM(quantity * price_unit) AS total, COUNT(*) AS n FROM lines GROUP BY 1) x ON x.project_id = t.project_id""",
       VIEWS, f"{TERMS}, {_lines_sql('employee_email')}")
def tm_invoice_total(t):
    return bl.tm_invoice_total(_lines(t, rate_key="employee_email"), t.view("billing_config"))


@query("timesheet_id_chunks", "project_id:l employee_id:l chunk:l timesheet_ids:s",
       """SELECT project_id, employee_id, id // 1000 AS chunk, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT id)), ',') AS timesheet_ids
 FROM open_ts WHERE project_id IN (SELECT project_id FROM terms WHERE billing_type = 'tm') GROUP BY 1, 2, 3""", VIEWS, TERMS)
def timesheet_id_chunks(t):
    df = bl.timesheet_id_chunks(t.view("timesheet"), t.view("billing_config"), START, END)
    return df.withColumn("timesheet_ids", F.concat_ws(",", F.transform("timesheet_ids", lambda x: x.cast("string"))))


@query("timesheet_link", "project_id:l timesheet_id:l sale_order_id:l",
       """SELECT DISTINCT project_id, employee_id, id AS timesheet_id, 100000 + project_id AS sale_order_id FROM open_ts
 WHERE project_id IN (SELECT project_id FROM terms WHERE billing_type = 'tm')""", VIEWS, TERMS)
def timesheet_link(t):
    chunks = bl.timesheet_id_chunks(t.view("timesheet"), t.view("billing_config"), START, END)
    created = t.view("billing_config").selectExpr("project_id", "100000 + project_id AS sale_order_id")
    return bl.timesheet_link(chunks, created)


@query("intake_flatten", "portfolio_name:s sponsor_email:s budget_total:d start_date:s description:s page_id:s priority:s",
       """SELECT COALESCE(NULLIF(p->>'$.properties.Name.title[0].plain_text', ''), 'Untitled') AS portfolio_name,
 COALESCE(p->>'$.properties.Sponsor.email', '') AS sponsor_email,
 COALESCE(CAST(p->>'$.properties.Budget.number' AS DOUBLE), 0) AS budget_total,
 NULLIF(p->>'$.properties.StartDate.date.start', '') AS start_date,
 COALESCE(p->>'$.properties.Description.rich_text[0].plain_text', '') AS description, p->>'$.id' AS page_id,
 COALESCE(NULLIF(p->>'$.properties.Priority.select.name', ''), 'Medium') AS priority FROM intake""", "intake")
def intake_flatten(t):
    return bl.intake_flatten(t.view("intake"))


@query("ocr_invoice_lines", "doc_id:l vendor:s amount:d date:s sku:s qty:l",
       r"""SELECT doc_id, tb->>'$.vendor' AS vendor,
 TRY_CAST(REGEXP_EXTRACT(tb->>'$.total', '^\s*([+-]?[0-9]+(\.[0-9]*)?)', 1) AS DOUBLE) AS amount, tb->>'$.date' AS date,
 it->>'$.sku' AS sku, CAST(it->>'$.qty' AS BIGINT) AS qty FROM
 (SELECT doc_id, tb, UNNEST(CASE WHEN json_array_length(tb, '$.items') = 0 THEN [NULL] ELSE CAST(tb->'$.items' AS JSON[]) END) AS it FROM
  (SELECT doc_id, UNNEST(CAST(p->'$.tables' AS JSON[])) AS tb FROM ocr) a WHERE tb->>'$.type' = 'invoice') b""", "ocr")
def ocr_invoice_lines(t):
    return bl.ocr_invoice_lines(t.view("ocr"))


PROJECTION_SQL = """SELECT i.invoice_id, c.c_name AS partner_name, i.amount_total, i.state, i.invoice_date,
 CASE WHEN c.c_nationkey < 13 THEN 'EUR' ELSE 'PHP' END AS currency, c.c_nationkey AS company_id
 FROM invoices i LEFT JOIN customer c ON i.partner_id = c.c_custkey"""


@query("invoice_projection", "invoice_id:l partner_name:s amount_total:d state:s invoice_date:s currency:s company_id:l",
       PROJECTION_SQL, "invoices")
def invoice_projection(t):
    return bl.invoice_projection(t.view("invoice_events"))


@query("invoice_search", "invoice_id:l partner_id:l state:s amount_total:d invoice_date:s",
       """SELECT * FROM invoices WHERE state = 'posted' AND invoice_date >= DATE '1997-01-01' AND invoice_date <= DATE '1997-12-31'
""", "invoices")
def invoice_search(t):
    df = bl.invoice_search(t.view("invoices"), state="posted", date_from=dt.date(1997, 1, 1), date_to=dt.date(1997, 12, 31))
    return df.withColumn("invoice_date", F.col("invoice_date").cast("date"))


@query("period_filter", "period:s n_rows:l amount:d", """
SELECT 'this_month' AS period, COUNT(*) AS n_rows, SUM(amount_total) AS amount FROM invoices
 WHERE invoice_date >= DATE '1997-06-01' AND invoice_date < DATE '1997-07-01' UNION ALL
SELECT 'last_month', COUNT(*), SUM(amount_total) FROM invoices WHERE invoice_date >= DATE '1997-05-01' AND invoice_date < DATE '1997-06-01' UNION ALL
SELECT 'this_quarter', COUNT(*), SUM(amount_total) FROM invoices WHERE invoice_date >= DATE '1997-04-01' AND invoice_date < DATE '1997-07-01' UNION ALL
SELECT 'ytd', COUNT(*), SUM(amount_total) FROM invoices WHERE invoice_date >= DATE '1997-01-01' AND invoice_date <= DATE '1997-06-15'""", "invoices")
def period_filter(t):
    return bl.period_summary(t.view("invoices"), ["this_month", "last_month", "this_quarter", "ytd"], AS_OF)


@query("financial_summary", "state:s n_invoices:l amount:d n_partners:l",
       """SELECT state, COUNT(*) AS n_invoices, SUM(amount_total) AS amount, COUNT(DISTINCT partner_id) AS n_partners
 FROM invoices WHERE invoice_date >= DATE '1997-04-01' AND invoice_date < DATE '1997-07-01' GROUP BY 1""", "invoices")
def financial_summary(t):
    return bl.financial_summary(t.view("invoices"), "this_quarter", AS_OF)


OVERDUE = "overdue AS (SELECT *, DATEDIFF('day', due_date, DATE '1997-06-15') AS days FROM invoices WHERE state = 'posted')"


@query("ar_aging", "bucket:s n_invoices:l amount:d",
       """SELECT CASE WHEN days <= 30 THEN '0-30' WHEN days <= 60 THEN '31-60' WHEN days <= 90 THEN '61-90' ELSE '90+' END AS bucket,
 COUNT(*) AS n_invoices, SUM(amount_total) AS amount FROM overdue WHERE days >= 0 GROUP BY 1""", "invoices", OVERDUE)
def ar_aging(t):
    return bl.ar_aging(t.view("invoices"), AS_OF)


@query("ar_top_overdue", "partner_id:l amount:d",
       "SELECT partner_id, SUM(amount_total) AS amount FROM overdue WHERE days > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
       "invoices", OVERDUE)
def ar_top_overdue(t):
    return bl.top_overdue(t.view("invoices"), AS_OF, limit=10)


@query("ar_aging_trend", "month:s amount:d",
       "SELECT CAST(DATE_TRUNC('month', due_date) AS DATE) AS month, SUM(amount_total) AS amount FROM overdue WHERE days > 0 GROUP BY 1",
       "invoices", OVERDUE)
def ar_aging_trend(t):
    return bl.aging_trend(t.view("invoices"), AS_OF)
