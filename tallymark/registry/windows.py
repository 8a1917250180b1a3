from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import changes as chg
from tallymark.registry.core import cents, half_up, query
from tallymark.session import materialize
from tallymark.sources.views import MONEY, money


@query("upsert_latest", "user_id:l event_id:l event_type:s value:d",
       """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) z
 WHERE rn = 1""")
def upsert_latest(t):
    return chg.upsert_latest(t.view("events_ts"), ["user_id"], ["ts", "event_id"])


def lines_of(lines, orders):
    """The lines of ``orders``. The range of their keys is a literal of the scan, so row groups outside it are not read."""
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    near = lines.filter(F.col("l_orderkey").between(low, high))
    return near.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")


def budget_changes(t, orders=None):
    """Each order writes its month's budget row: planned is the order's price, actual its list price. ``orders``: only these."""
    lines = t.lineitem if orders is None else lines_of(t.lineitem, orders)
    per_order = lines.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("gross"))
    return ((t.orders if orders is None else orders).join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("c_nationkey").alias("company_id"), F.col("o_custkey").alias("project_id"),
                    F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("snapshot_date"), F.col("o_orderkey").alias("change_id"),
                    money("o_totalprice").cast(MONEY).alias("planned_amount"), F.col("gross").cast(MONEY).alias("actual_amount")))


PCT = half_up(cents("(actual_amount - planned_amount)") + "*100", cents("planned_amount"), 2)
AUDIT_CTE = """bc AS (SELECT c_nationkey AS company_id, o_custkey AS project_id, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS snapshot_date,
 o_orderkey AS change_id, CAST(o_totalprice AS DECIMAL(20,2)) AS planned_amount,
 CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS actual_amount
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
 GROUP BY c_nationkey, o_custkey, o_orderdate, o_orderkey, o_totalprice)"""
AUDIT_TEXT = f"""SELECT company_id, 'budget_sync' AS workflow_type, CAST(project_id AS VARCHAR) AS source_record_id, change_id,
 CASE WHEN ROW_NUMBER() OVER (PARTITION BY company_id, project_id, snapshot_date ORDER BY {{arrival}}) = 1 THEN 'created'
 ELSE 'updated' END AS action, '{{"planned":' || planned_amount || ',"actual":' || actual_amount || ',"variance_pct":'
 || CAST(CASE WHEN planned_amount > 0 THEN {PCT} ELSE 0 END AS DECIMAL(20,2)) || '}}' AS metadata FROM bc"""


def audit_sql(arrival: str) -> str:
    """The audit rows, if changes arrive in this order."""
    return AUDIT_TEXT.replace("{arrival}", arrival)


AUDIT_SQL = audit_sql("change_id")
AUDIT_SPEC = "company_id:l workflow_type:s source_record_id:s change_id:l action:s metadata:s"
AUDIT_KEYS = ["company_id", "project_id", "snapshot_date"]


@query("budget_audit", AUDIT_SPEC, AUDIT_SQL, "", AUDIT_CTE)
def budget_audit(t):
    return chg.budget_audit(materialize(budget_changes(t), "changes"), AUDIT_KEYS, "change_id")


@query("clearance_timeline", "company_id:l clearance_request_id:l event_id:l event_type:s previous:s micros_since:l",
       """SELECT *, LAG(event_type) OVER w AS previous, EPOCH_US(created_at) - EPOCH_US(LAG(created_at) OVER w) AS micros_since
 FROM clearance_events WINDOW w AS (PARTITION BY company_id, clearance_request_id ORDER BY created_at, event_id)""", "clearance_events")
def clearance_timeline(t):
    return chg.timeline(t.view("clearance_events"), ["company_id", "clearance_request_id"], "created_at", "event_id", "event_type")


@query("clearance_last_event", "company_id:l clearance_request_id:l event_type:s n_events:l",
       """SELECT company_id, clearance_request_id, MAX_BY(event_type, (created_at, event_id)) AS event_type, COUNT(*) AS n_events
 FROM clearance_events GROUP BY 1, 2""", "clearance_events")
def clearance_last_event(t):
    return (t.view("clearance_events").groupBy("company_id", "clearance_request_id")
            .agg(F.max_by("event_type", F.struct("created_at", "event_id")).alias("event_type"), F.count("*").alias("n_events")))
