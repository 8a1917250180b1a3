"""Project finance: utilisation, budget variance, earned value, project health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.scalars import js_or, mean, ratio_or
from tallymark.functions.status import health_status
from tallymark.sources.views import MONEY, PERCENT, RATIO

c = F.col


def utilization_pct(capacity: DataFrame) -> DataFrame:
    return capacity.withColumn(
        "utilization_pct", ratio_or(c("allocated_hours"), c("available_hours"), F.lit(0), PERCENT, 100))


def resource_utilization(capacity: DataFrame) -> DataFrame:
    """Monthly sums per name and e-mail; the utilisation is the mean of the weekly ratios."""
    return (utilization_pct(capacity)
            .groupBy("company_id", "resource_name", "resource_email", F.trunc("week_of", "MM").alias("month"))
            .agg(F.sum("available_hours").alias("total_available"), F.sum("allocated_hours").alias("total_allocated"),
                 F.sum("billable_hours").alias("total_billable"), mean(c("utilization_pct")).alias("avg_utilization")))


def capacity_vs_demand(capacity: DataFrame, demand: DataFrame) -> DataFrame:
    """Weekly available against requested hours per resource; either side may be missing."""
    have = capacity.groupBy("resource_id", "week_of").agg(F.sum("available_hours").alias("available_hours"))
    need = demand.groupBy("resource_id", "week_of").agg(F.sum("requested_hours").alias("requested_hours"))
    zero = F.lit(0).cast(MONEY)
    return (have.join(need, ["resource_id", "week_of"], "full")
            .select("resource_id", "week_of", F.coalesce("available_hours", zero).alias("available_hours"),
                    F.coalesce("requested_hours", zero).alias("requested_hours"))
            .withColumn("over_allocated", c("requested_hours") > c("available_hours")))


def budget_variance(budget: DataFrame) -> DataFrame:
    gap = c("actual_amount") - c("planned_amount")
    return budget.withColumns({
        "variance_amount": gap.cast(MONEY),
        "variance_pct": ratio_or(gap, c("planned_amount"), F.lit(0), PERCENT, 100)})


def evm_metrics(evm: DataFrame) -> DataFrame:
    """Indices first; the forecast divides by the index as stored, that is at three places."""
    ev, ac, pv, bac = c("ev"), c("ac"), c("pv"), c("bac")
    indices = evm.withColumns({
        "cpi": ratio_or(ev, ac, F.lit(0), RATIO), "spi": ratio_or(ev, pv, F.lit(0), RATIO),
        "cv": (ev - ac).cast(MONEY), "sv": (ev - pv).cast(MONEY),
        "pct_complete": ratio_or(ev, bac, F.lit(0), PERCENT, 100)})
    forecast = indices.withColumn("eac", ratio_or(bac, c("cpi"), bac, MONEY))
    return forecast.withColumn("vac", (bac - c("eac")).cast(MONEY))


def evm_etc(evm: DataFrame) -> DataFrame:
    """Estimate to complete with the unrounded index; null-safe on zero cost."""
    index = c("ev") / F.nullif(c("ac"), F.lit(0).cast(MONEY))
    # left / (ev/ac) = left * ac / ev in whole hundredths, because a decimal
    # quotient this wide keeps six places and would be rounded twice
    cents = F.expr("CAST((200 * abs((bac - ev) * ac) + abs(ev)) DIV (2 * abs(ev)) AS DECIMAL(20,0))"
                   " * CASE WHEN bac < ev THEN -1 ELSE 1 END")
    return evm.withColumn("etc", F.when(index > 0, cents * F.lit("0.01").cast("decimal(3,2)"))
                          .otherwise(c("bac") - c("ev")).cast(MONEY))


def calculate_project_evm(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Fold repeated calculations into one row per key.

    A later call replaces the amounts and the estimate to complete; the project
    name stays as the first call wrote it.
    """
    stamp = F.struct(*order)
    amounts = ["bac", "pv", "ev", "ac", "etc"]
    return (evm_etc(calls).groupBy(*keys)
            .agg(F.min_by("project_name", stamp).alias("project_name"), F.max_by(F.struct(*amounts), stamp).alias("_last"))
            .select(*keys, "project_name", "_last.*"))


def latest_snapshot(df: DataFrame, keys: list[str], order: str, unique: bool = False) -> DataFrame:
    """Rows at the per-key maximum of ``order``, ties kept.

    In general an aggregate and a semi join on (keys, order): a key with many
    rows is folded on the map side and its rows stay spread by date. Where
    (keys, order) is declared unique and ``order`` is a date, a key has at most
    one row per day, and a window does the same in one pass.
    """
    if unique:
        newest = F.max(order).over(Window.partitionBy(*keys))
        return df.withColumn("_newest", newest).filter(c(order) == c("_newest")).drop("_newest")
    newest = df.groupBy(*keys).agg(F.max(order).alias(order))
    return df.join(newest, [*keys, order], "left_semi")


def project_health(evm: DataFrame, budget: DataFrame) -> DataFrame:
    """Latest earned-value row per project, its same-day budget variance, and a colour."""
    keys = ["company_id", "project_id"]
    day = [*keys, "calculation_date"]
    # pick the rows first, then compute on what is left
    latest = evm_metrics(latest_snapshot(evm, keys, "calculation_date", unique=True))
    plans = budget.select(*keys, c("snapshot_date").alias("calculation_date"), "planned_amount", "actual_amount",
                          F.lit(True).alias("_planned"))
    return (budget_variance(latest.join(plans, day, "left"))
            .select(*keys, "project_name", "calculation_date", "pct_complete", "cpi", "spi",
                    F.when(c("_planned"), c("variance_pct")).alias("budget_variance_pct"),
                    health_status(c("cpi"), c("spi")).alias("health_status")))


def actuals_by_project(ledger: DataFrame) -> DataFrame:
    return (ledger.filter(c("project_id").isNotNull()).groupBy("project_id").agg(F.sum("amount").alias("amount")))


def budget_vs_actual(budgets: DataFrame, actuals: DataFrame) -> DataFrame:
    """Budgets beside the absolute actual of their project; a missing or zero actual is 0."""
    spent = actuals.select("project_id", F.abs("amount").cast(MONEY).alias("actual"))
    return (budgets.join(spent, "project_id", "left")
            .withColumn("actual", F.coalesce("actual", F.lit(0).cast(MONEY)))
            .withColumn("planned", F.coalesce("planned_amount", F.lit(0).cast(MONEY))).drop("planned_amount"))


def variance_alerts(compared: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows whose absolute variance exceeds the threshold (null or 0 means 10); zero plans are dropped."""
    limit = js_or(F.lit(threshold).cast("double"), 10.0)
    pct = (c("actual") - c("planned")) / c("planned") * 100
    return (compared.filter(c("planned") > 0).withColumn("raw_pct", pct)
            .filter(F.abs("raw_pct") > limit.cast("decimal(20,6)"))
            .withColumns({"variance_pct": F.round("raw_pct", 2),
                          "variance_type": F.when(c("raw_pct") > 0, "OVER").otherwise("UNDER"),
                          "severity": F.when(F.abs("raw_pct") > 25, "HIGH").otherwise("MEDIUM"),
                          "project_name": js_or(c("project_name"), "Unknown")}).drop("raw_pct"))


def alert_audit(alerts: DataFrame) -> DataFrame:
    """Audit rows for the alerts, with the whole alert as JSON."""
    return alerts.select(
        F.lit("variance_alert").alias("workflow_type"), F.lit("odoo").alias("source_system"),
        c("project_id").cast("string").alias("source_record_id"),
        F.concat(F.lit("alert_"), F.lower("severity")).alias("action"),
        F.to_json(F.struct("project_id", "variance_type", "severity")).alias("metadata"))


def budget_spent(projects: DataFrame, ledger: DataFrame) -> DataFrame:
    """Absolute sum of the negative ledger lines; 0 for a project without account or lines."""
    spent = (ledger.filter(c("amount") < 0).groupBy("project_id")
             .agg(F.sum(F.abs("amount")).cast(MONEY).alias("spent")))
    return (projects.join(spent, "project_id", "left")
            .withColumn("budget_spent", F.when(c("account_id").isNotNull(), F.coalesce("spent", F.lit(0)))
                        .otherwise(0).cast(MONEY)).drop("spent"))


def project_remaining(projects: DataFrame, ledger: DataFrame) -> DataFrame:
    return budget_spent(projects, ledger).withColumn(
        "budget_remaining", (c("budget_total") - c("budget_spent")).cast(MONEY))
