"""Final-pay clearance: SLA columns, dashboards, timeline, event application."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.scalars import mean
from tallymark.functions.status import INTERNAL_DAYS, STATUTORY_DAYS, sla_status, statutory_compliant

c = F.col


def sla_days(sla: DataFrame) -> DataFrame:
    done = c("final_pay_executed_date")
    return sla.withColumns({"days_to_execute": F.datediff(done, "clearance_date"),
                            "days_to_statutory": F.datediff(done, "last_working_date")})


def sla_due_dates(sla: DataFrame) -> DataFrame:
    return sla.withColumns({
        "final_pay_due_date_internal": F.date_add("clearance_date", INTERNAL_DAYS),
        "final_pay_due_date_statutory": F.date_add("last_working_date", STATUTORY_DAYS)})


def sla_compliance(sla: DataFrame, as_of: dt.date) -> DataFrame:
    """Every derived SLA column at ``as_of``, in dependency order."""
    df = sla_days(sla_due_dates(sla))
    done = c("final_pay_executed_date")
    return df.withColumns({
        "internal_sla_status": sla_status(done, c("final_pay_due_date_internal"), as_of),
        "statutory_compliant": statutory_compliant(done, c("days_to_statutory"))})


def sla_dashboard(sla: DataFrame, as_of: dt.date) -> DataFrame:
    """One conditional-count pass per company."""
    status = c("internal_sla_status")
    counted = sla_compliance(sla, as_of).groupBy("company_id").agg(
        F.count("*").alias("total_requests"),
        *[F.count_if(status == s).alias(f"{s}_count") for s in ("compliant", "at_risk", "breach", "pending")],
        mean(c("days_to_execute")).alias("avg_days_to_execute"),
        F.count_if(~c("statutory_compliant")).alias("statutory_breach_count"))
    judged = F.nullif(c("compliant_count") + c("breach_count"), F.lit(0).cast("bigint"))
    return counted.withColumn(
        "compliance_rate", F.round(c("compliant_count").cast("decimal(20,0)") * 100 / judged.cast("decimal(20,0)"), 2))


def pending_clearances(sla: DataFrame, as_of: dt.date) -> DataFrame:
    today = F.lit(as_of)
    return (sla_compliance(sla.filter(c("final_pay_executed_date").isNull()), as_of)
            .select("company_id", "clearance_request_id", "employee_id", "employee_name", "department",
                    "last_working_date", "clearance_date", "final_pay_due_date_internal", "internal_sla_status",
                    F.datediff(today, F.coalesce("clearance_date", "last_working_date")).alias("days_since_exit"),
                    F.datediff("final_pay_due_date_internal", today).alias("days_until_sla")))


def clearance_by_department(checklist: DataFrame) -> DataFrame:
    done, total = c("cleared_items").cast("decimal(20,0)"), c("total_items").cast("decimal(20,0)")
    return (checklist.groupBy("company_id", "clearance_request_id", "department")
            .agg(F.count("*").alias("total_items"), F.count_if(c("is_cleared")).alias("cleared_items"))
            .withColumn("completion_pct", F.round(done * 100 / total, 0)))


def init_if_absent(events: DataFrame, keys: list[str], order: list[str], touched: str) -> DataFrame:
    """The first event per key creates the row; later ones only move ``updated_at``."""
    values = [x for x in events.columns if x not in keys]
    return (events.groupBy(*keys)
            .agg(F.min_by(F.struct(*values), F.struct(*order)).alias("first"), F.max(touched).alias("updated_at"))
            .select(*keys, *[c(f"first.{v}").alias(v) for v in values], "updated_at"))


# The events that write the SLA row, and what the audit keeps of each.
TOUCHING = ("created", "clearance_complete", "final_pay_executed")
PAY = {"gross_pay": "gross_final_pay", "deductions": "deductions_total", "net_pay": "net_final_pay"}


def clearance_audit(events: DataFrame) -> DataFrame:
    """One audit row per event that writes the SLA row, with the values it set as JSON."""
    kind = c("event_type")
    day = c("created_at").cast("date").cast("string")
    values = (F.when(kind == "clearance_complete", F.to_json(F.struct(day.alias("clearance_date"))))
              .when(kind == "final_pay_executed", F.to_json(F.struct(*[c(x).cast("string").alias(x) for x in PAY])))
              .when(kind == "created", F.to_json(F.struct(day.alias("opened")))))
    return events.filter(kind.isin(*TOUCHING)).select(
        "company_id", "clearance_request_id", "event_id", "event_type", "created_at", values.alias("new_values"))


def apply_clearance_events(sla: DataFrame, events: DataFrame, as_of: dt.date) -> DataFrame:
    """Fold clearance events into SLA rows, then derive the status columns.

    Only the events that write the row (``TOUCHING``) move ``updated_at``.
    'clearance_complete' sets the clearance date and 'final_pay_executed' the
    execution date, pay, deductions and net pay; the last one of each kind wins. Events for unknown
    requests change nothing.
    """
    keys = ["company_id", "clearance_request_id"]
    stamp = F.struct("created_at", "event_id")

    def last(kind: str, value):
        return F.max_by(F.when(c("event_type") == kind, value), F.when(c("event_type") == kind, stamp))

    folded = events.groupBy(*keys).agg(
        last("clearance_complete", c("created_at").cast("date")).alias("new_clearance"),
        last("final_pay_executed", c("created_at").cast("date")).alias("new_executed"),
        *[last("final_pay_executed", c(x)).alias(f"new_{x}") for x in PAY],
        F.max(F.when(c("event_type").isin(*TOUCHING), c("created_at"))).alias("updated_at"))
    merged = sla.join(folded, keys, "left").withColumns({
        "clearance_date": F.coalesce("new_clearance", "clearance_date"),
        "final_pay_executed_date": F.coalesce("new_executed", "final_pay_executed_date"),
        **{out: c(f"new_{x}") for x, out in PAY.items()}}).drop("new_clearance", "new_executed", *[f"new_{x}" for x in PAY])
    return sla_compliance(merged, as_of)
