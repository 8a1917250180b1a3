"""Streams over the event and order files, re-read as tables so batch SQL can check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.registry.core import query
from tallymark.registry.windows import AUDIT_CTE, AUDIT_KEYS, AUDIT_SPEC, audit_sql, budget_changes
from tallymark.session import materialize, work_dir
from tallymark.sources import views
from tallymark.sources.tables import SCHEMAS
from tallymark.streaming import feeds


class Streamed:
    """The base tables with some of them read as streams, so the batch views apply to streams as well."""

    def __init__(self, tables, *streams: str):
        self._tables, self._streams = tables, streams

    def __getattr__(self, name: str):
        if name in self._streams:
            return feeds.change_feed_source(self._tables.spark, f"{self._tables.folder}/{name}.parquet", SCHEMAS[name], time_column=None)
        return getattr(self._tables, name)


def events_stream(t):
    return feeds.change_feed_source(t.spark, f"{t.folder}/events.parquet", SCHEMAS["events"], max_files=1000)


@query("change_feed_source", "event_id:l user_id:l event_type:s value:d ts_us:l",
       "SELECT event_id, user_id, event_type, value, EPOCH_US(ts) AS ts_us FROM events")
def change_feed_source(t):
    return feeds.append_stream(events_stream(t), "feed").withColumn("ts_us", F.unix_micros("ts"))


@query("stream_upsert", "user_id:l event_id:l event_type:s value:d",
       """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) z WHERE rn = 1""")
def stream_upsert(t):
    return feeds.stream_upsert(events_stream(t), ["user_id"], ["ts", "event_id"])


ARRIVALS = 4


@query("stream_budget_audit", AUDIT_SPEC,
       audit_sql(f"change_id * {ARRIVALS} // (SELECT MAX(o_orderkey) + 1 FROM orders) DESC, change_id"), "", AUDIT_CTE)
def stream_budget_audit(t):
    """The orders arrive in four ranges of their keys, the last one first; the job is started for each."""
    last = t.orders.agg(F.max("o_orderkey")).first()[0] or 0
    part = F.expr(f"o_orderkey * {ARRIVALS} DIV {last + 1}")
    feed, folder = work_dir(t.spark, "orders_feed"), work_dir(t.spark, "budget_audit")
    for arrival in reversed(range(ARRIVALS)):
        t.orders.filter(part == arrival).write.mode("append").parquet(feed)
        stream = feeds.change_feed_source(t.spark, feed, SCHEMAS["orders"], time_column=None)
        audit = feeds.stream_budget_audit(stream, lambda batch: budget_changes(t, batch), AUDIT_KEYS, "change_id", folder)
    return audit


@query("stream_large_invoice", "invoice_id:l partner_id:l amount_total:d state:s",
       "SELECT * FROM invoices WHERE amount_total >= 10000", "invoices")
def stream_large_invoice(t):
    return feeds.stream_large_invoices(views.invoices(Streamed(t, "orders")))


@query("stream_drift_alert", "id:l environment:s title:s body:s url:s",
       """SELECT id, environment, 'Drift in ' || environment AS title, 'Dashboard configuration has drifted' AS body, '/drift/' || id AS url
 FROM drift_log WHERE status = 'drift_found'""", "drift_log")
def stream_drift_alert(t):
    return feeds.append_stream(views.drift_log(Streamed(t, "events")), "drift", feeds.drift_alerts)


AUDIT_LOG_SQL = """SELECT event_id, company_id, workflow_type, source_system, '{"props":"' || REPLACE(props, '"', '\\"') || '"}' AS metadata,
 workflow_type <> 'unknown_flow' AS accepted FROM workflow_events""".replace("\\\\", "\\")


def _audited(t):
    return feeds.stream_audit_log(views.workflow_events(Streamed(t, "events")))


@query("stream_audit_log", "event_id:l company_id:l workflow_type:s source_system:s metadata:s accepted:b", AUDIT_LOG_SQL, "workflow_events")
def stream_audit_log(t):
    """Both tables of the job, told apart by where they were found."""
    out = _audited(t)
    return out.read("accepted").withColumn("accepted", F.lit(True)).unionByName(out.read("quarantine").withColumn("accepted", F.lit(False)))


@query("stream_audit_quarantine", "event_id:l company_id:l workflow_type:s source_system:s metadata:s",
       f"SELECT * FROM ({AUDIT_LOG_SQL}) a WHERE NOT accepted", "workflow_events")
def stream_audit_quarantine(t):
    return _audited(t).read("quarantine")


@query("stream_audit_ledger", "sink:s rows:l",
       f"""SELECT CASE WHEN accepted THEN 'accepted' ELSE 'quarantine' END AS sink, COUNT(*) AS rows FROM ({AUDIT_LOG_SQL}) a GROUP BY 1""",
       "workflow_events")
def stream_audit_ledger(t):
    """What the ledger states for all batches, against a count of the events."""
    return _audited(t).ledger().groupBy("sink").agg(F.sum("rows").alias("rows"))


@query("stream_windowed_counts", "day:s event_type:s n:l",
       """SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n FROM events
 WHERE CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= (SELECT MAX(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2""")
def stream_windowed_counts(t):
    """Only closed windows appear: those that end before the last event minus the delay."""
    counts = feeds.append_stream(events_stream(t), "windows", lambda df: feeds.windowed_counts(df, "ts", "event_type"))
    return counts.withColumn("day", F.col("window_start").cast("date"))


ON_TIME = "ts < {kind}'2024-01-16 00:00:00' AND event_id % 10 <> 0"


@query("scheduled_snapshot", "run:l user_id:l event_id:l event_type:s value:d",
       f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM
 (SELECT 1 AS run, * FROM events WHERE {ON_TIME.format(kind="TIMESTAMP ")} UNION ALL SELECT 2, * FROM events) z) y WHERE rn = 1""")
def scheduled_snapshot(t):
    """The daily job started twice on one folder; newer and late events arrive in between. The table after either start."""
    feed, folder = work_dir(t.spark, "daily_feed"), work_dir(t.spark, "daily")
    on_time = F.expr(ON_TIME.format(kind="TIMESTAMP_NTZ"))
    runs = []
    for run, arrived in enumerate((on_time, ~on_time), 1):
        t.events.filter(arrived).write.mode("append").parquet(feed)
        stream = feeds.change_feed_source(t.spark, feed, SCHEMAS["events"])
        runs.append(materialize(feeds.stream_upsert(stream, ["user_id"], ["ts", "event_id"], folder), "daily")
                    .withColumn("run", F.lit(run)))
    return runs[0].unionByName(runs[1])
