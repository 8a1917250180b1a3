from __future__ import annotations

import datetime as dt

from tallymark.operators import clearance as cl
from tallymark.registry.core import half_up, query

AS_OF = dt.date(1997, 6, 15)
# How late a case is, in days past its due date: the day it was paid, or today while it is open. One number decides the status.
DAYS_CTE = """s1 AS (SELECT *, final_pay_executed_date - clearance_date AS days_to_execute,
 final_pay_executed_date - last_working_date AS days_to_statutory,
 CAST(clearance_date + INTERVAL 7 DAY AS DATE) AS final_pay_due_date_internal,
 CAST(last_working_date + INTERVAL 30 DAY AS DATE) AS final_pay_due_date_statutory FROM {src}),
late AS (SELECT *, final_pay_executed_date IS NOT NULL AS paid,
 COALESCE(final_pay_executed_date, DATE '1997-06-15') - final_pay_due_date_internal AS days_late FROM s1),
s2 AS (SELECT * EXCLUDE (paid, days_late), CASE WHEN days_late IS NULL THEN 'pending' WHEN days_late > 0 THEN 'breach' WHEN paid THEN 'compliant'
 ELSE ['pending', 'at_risk'][1 + CAST(days_late > -2 AS INT)] END AS internal_sla_status, days_to_statutory <= 30 AS statutory_compliant FROM late)"""
SLA_CTE = DAYS_CTE.format(src="sla")


@query("sla_days", "clearance_request_id:l days_to_execute:l days_to_statutory:l", "SELECT * FROM s1", "sla", SLA_CTE)
def sla_days(t):
    return cl.sla_days(t.view("sla"))


@query("sla_due_dates", "clearance_request_id:l final_pay_due_date_internal:s final_pay_due_date_statutory:s",
       "SELECT * FROM s1", "sla", SLA_CTE)
def sla_due_dates(t):
    return cl.sla_due_dates(t.view("sla"))


@query("sla_status", "company_id:l clearance_request_id:l internal_sla_status:s", "SELECT * FROM s2", "sla", SLA_CTE)
def sla_status(t):
    return cl.sla_compliance(t.view("sla"), AS_OF)


@query("statutory_compliant", "company_id:l clearance_request_id:l days_to_statutory:l statutory_compliant:b",
       "SELECT * FROM s2", "sla", SLA_CTE)
def statutory(t):
    return cl.sla_compliance(t.view("sla"), AS_OF)


_RATE = half_up("100 * COUNT(*) FILTER (WHERE internal_sla_status = 'compliant')",
                "NULLIF(COUNT(*) FILTER (WHERE internal_sla_status IN ('compliant', 'breach')), 0)", 2)


_COUNTED = ("compliant", "at_risk", "breach", "pending")


@query("sla_dashboard", "company_id:l total_requests:l compliant_count:l at_risk_count:l breach_count:l pending_count:l"
       " compliance_rate:d avg_days_to_execute:d statutory_breach_count:l",
       f"""SELECT company_id, len(cases) AS total_requests, {', '.join(f"len(list_filter(cases, lambda s: s = '{s}')) AS {s}_count" for s in _COUNTED)},
 compliance_rate, avg_days_to_execute, statutory_breach_count FROM (SELECT company_id, list(internal_sla_status) AS cases, {_RATE} AS compliance_rate,
 AVG(days_to_execute) AS avg_days_to_execute, COUNT_IF(NOT statutory_compliant) AS statutory_breach_count FROM s2 GROUP BY company_id) c""",
       "sla", SLA_CTE)
def sla_dashboard(t):
    return cl.sla_dashboard(t.view("sla"), AS_OF)


@query("pending_clearances", "company_id:l clearance_request_id:l employee_id:l employee_name:s department:s last_working_date:s"
       " clearance_date:s final_pay_due_date_internal:s internal_sla_status:s days_since_exit:l days_until_sla:l",
       """SELECT *, DATEDIFF('day', COALESCE(clearance_date, last_working_date), DATE '1997-06-15') AS days_since_exit,
 DATEDIFF('day', DATE '1997-06-15', final_pay_due_date_internal) AS days_until_sla FROM s2
 WHERE final_pay_executed_date IS NULL""", "sla", SLA_CTE)
def pending_clearances(t):
    return cl.pending_clearances(t.view("sla"), AS_OF)


_DONE = half_up("100 * COUNT(*) FILTER (WHERE is_cleared)", "COUNT(*)", 0)


@query("clearance_by_department", "company_id:l clearance_request_id:l department:s total_items:l cleared_items:l completion_pct:d",
       f"""SELECT company_id, clearance_request_id, department, COUNT(*) AS total_items,
 COUNT(*) FILTER (WHERE is_cleared) AS cleared_items, {_DONE} AS completion_pct FROM checklist GROUP BY 1, 2, 3""", "checklist")
def clearance_by_department(t):
    return cl.clearance_by_department(t.view("checklist"))


@query("init_if_absent", "company_id:l clearance_request_id:l event_id:l event_type:s gross_pay:d created_us:l updated_us:l",
       """SELECT *, EPOCH_US(created_at) AS created_us, EPOCH_US(updated_at) AS updated_us FROM (SELECT *,
 MAX(created_at) OVER (PARTITION BY company_id, clearance_request_id) AS updated_at,
 ROW_NUMBER() OVER (PARTITION BY company_id, clearance_request_id ORDER BY created_at, event_id) AS rn
 FROM clearance_events) z WHERE rn = 1""", "clearance_events")
def init_if_absent(t):
    df = cl.init_if_absent(t.view("clearance_events"), ["company_id", "clearance_request_id"],
                           ["created_at", "event_id"], "created_at")
    return df.selectExpr("*", "unix_micros(created_at) AS created_us", "unix_micros(updated_at) AS updated_us")


APPLY_CTE = """upd AS (SELECT company_id, clearance_request_id, CAST(MAX_BY(created_at, (created_at, event_id))
   FILTER (WHERE event_type = 'clearance_complete') AS DATE) AS nc,
 CAST(MAX_BY(created_at, (created_at, event_id)) FILTER (WHERE event_type = 'final_pay_executed') AS DATE) AS ne,
 MAX_BY(gross_pay, (created_at, event_id)) FILTER (WHERE event_type = 'final_pay_executed') AS ng,
 MAX(created_at) FILTER (WHERE event_type IN ('created', 'clearance_complete', 'final_pay_executed')) AS updated_at
 FROM clearance_events GROUP BY 1, 2),
base AS (SELECT user_id % 5 AS company_id, user_id AS clearance_request_id, user_id AS employee_id,
 CAST(MIN(ts) AS DATE) AS last_working_date, CAST(NULL AS DATE) AS clearance_date,
 CAST(NULL AS DATE) AS final_pay_executed_date FROM events GROUP BY 1, 2, 3),
merged AS (SELECT b.* REPLACE (COALESCE(nc, clearance_date) AS clearance_date,
 COALESCE(ne, final_pay_executed_date) AS final_pay_executed_date), ng AS gross_final_pay, updated_at,
 CAST(ng / 5 AS DECIMAL(18,2)) AS deductions_total, ng - CAST(ng / 5 AS DECIMAL(18,2)) AS net_final_pay
 FROM base b LEFT JOIN upd u ON u.company_id = b.company_id AND u.clearance_request_id = b.clearance_request_id),
"""


@query("apply_clearance_events", "company_id:l clearance_request_id:l clearance_date:s final_pay_executed_date:s"
       " gross_final_pay:d deductions_total:d net_final_pay:d days_to_execute:l internal_sla_status:s updated_us:l",
       "SELECT *, EPOCH_US(updated_at) AS updated_us FROM s2", "clearance_events", APPLY_CTE + DAYS_CTE.format(src="merged"))
def apply_clearance_events(t):
    opened = t.events.groupBy("user_id").agg({"ts": "min"}).selectExpr(
        "user_id % 5 AS company_id", "user_id AS clearance_request_id", "user_id AS employee_id",
        "CAST(`min(ts)` AS DATE) AS last_working_date", "CAST(NULL AS DATE) AS clearance_date",
        "CAST(NULL AS DATE) AS final_pay_executed_date")
    df = cl.apply_clearance_events(opened, paid_events(t), AS_OF)
    return df.selectExpr("*", "unix_micros(updated_at) AS updated_us")


def paid_events(t):
    """The events with a fifth of the pay as deductions."""
    return t.view("clearance_events").selectExpr(
        "*", "CAST(gross_pay / 5 AS DECIMAL(18,2)) AS deductions", "gross_pay - CAST(gross_pay / 5 AS DECIMAL(18,2)) AS net_pay")


@query("clearance_audit", "company_id:l clearance_request_id:l event_id:l event_type:s new_values:s",
       """SELECT company_id, clearance_request_id, event_id, event_type, CASE event_type
 WHEN 'created' THEN '{"opened":"' || strftime(created_at, '%Y-%m-%d') || '"}'
 WHEN 'clearance_complete' THEN '{"clearance_date":"' || strftime(created_at, '%Y-%m-%d') || '"}'
 ELSE '{' || array_to_string(list_filter([
   '"gross_pay":"' || CAST(gross_pay AS VARCHAR) || '"', '"deductions":"' || CAST(CAST(gross_pay / 5 AS DECIMAL(18,2)) AS VARCHAR) || '"',
   '"net_pay":"' || CAST(gross_pay - CAST(gross_pay / 5 AS DECIMAL(18,2)) AS VARCHAR) || '"'], lambda x: x IS NOT NULL), ',') || '}' END AS new_values
 FROM clearance_events WHERE event_type IN ('created', 'clearance_complete', 'final_pay_executed')""", "clearance_events")
def clearance_audit(t):
    return cl.clearance_audit(paid_events(t))
