from __future__ import annotations

import datetime as dt

from tallymark.operators import portfolio as pf
from tallymark.registry.core import query

SCORE = ("(35 * strategic_alignment + 30 * business_value + 15 * (100 - risk_level) + 20 * resource_availability)"
         " / 100.0::DOUBLE")
ROLLUP = """rolled AS (SELECT p.*, COALESCE(n, 0) AS project_count, COALESCE(b, 0) AS budget_allocated,
 p.budget_total - COALESCE(b, 0) AS budget_remaining FROM portfolios p LEFT JOIN
 (SELECT portfolio_id, COUNT(*) AS n, SUM(budget_total) AS b FROM projects GROUP BY 1) c ON c.portfolio_id = p.portfolio_id)"""


@query("portfolio_score", "portfolio_id:l total_score:d", f"SELECT portfolio_id, {SCORE} AS total_score FROM portfolios", "portfolios")
def portfolio_score(t):
    return pf.portfolio_score(t.view("portfolios"))


@query("portfolio_rollup", "portfolio_id:l project_count:l budget_total:d budget_allocated:d budget_remaining:d",
       "SELECT * FROM rolled", "portfolios projects", ROLLUP)
def portfolio_rollup(t):
    return pf.portfolio_rollup(t.view("portfolios"), t.view("projects"))


@query("portfolio_rank", "portfolio_id:l name:s priority:l total_score:d score_rank:l",
       f"SELECT *, {SCORE} AS total_score, RANK() OVER (ORDER BY {SCORE} DESC) AS score_rank FROM portfolios", "portfolios")
def portfolio_rank(t):
    return pf.portfolio_rank(t.view("portfolios"))


@query("state_map", "portfolio_id:l status_label:s state:s new_state:s",
       """SELECT *, CASE status_label WHEN 'Draft' THEN 'draft' WHEN 'Submitted' THEN 'submitted' WHEN 'Approved' THEN 'approved'
 WHEN 'Active' THEN 'active' WHEN 'On Hold' THEN 'on_hold' WHEN 'Closed' THEN 'closed' ELSE state END AS new_state
 FROM portfolios""", "portfolios")
def state_map(t):
    return pf.state_map(t.view("portfolios"))


@query("inherit_account", "project_id:l portfolio_id:l account_id:s",
       """SELECT j.project_id, j.portfolio_id, COALESCE(j.account_id, p.account_id) AS account_id FROM projects j
 LEFT JOIN portfolios p ON p.portfolio_id = j.portfolio_id""", "projects portfolios")
def inherit_account(t):
    return pf.inherit_account(t.view("projects"), t.view("portfolios"))


@query("skill_match", "resource_id:l",
       """SELECT resource_id FROM skills WHERE skill IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1
 HAVING COUNT(DISTINCT skill) = 3""", "skills")
def skill_match(t):
    return pf.skill_match(t.view("skills"), ["Brand#1", "Brand#2", "Brand#3"])


@query("tenant_scope", "company_id:l project_id:l snapshot_date:s planned_amount:d actual_amount:d",
       "SELECT * FROM budget WHERE company_id = 7", "budget")
def tenant_scope(t):
    return pf.tenant_scope(t.view("budget"), "company_id", 7)


@query("expired_rows", "event_id:l user_id:l",
       """SELECT event_id, user_id FROM events WHERE CASE WHEN event_type = 'signup' THEN ts + INTERVAL 1 HOUR
 ELSE ts + INTERVAL 86400 SECOND END <= TIMESTAMP '2024-01-15 12:00:00'""")
def expired_rows(t):
    tokens = t.view("events_ts").selectExpr("*", "CASE WHEN event_type = 'signup' THEN ts + INTERVAL 1 HOUR END AS expires_at")
    return pf.expired_rows(tokens, dt.datetime(2024, 1, 15, 12, tzinfo=dt.timezone.utc), "ts", expires="expires_at")


@query("q_over_allocated", "portfolio_id:l budget_total:d budget_allocated:d",
       "SELECT * FROM rolled WHERE budget_allocated > budget_total", "portfolios projects", ROLLUP)
def q_over_allocated(t):
    return pf.portfolio_rollup(t.view("portfolios"), t.view("projects")).filter("budget_allocated > budget_total")
