"""Portfolio scoring, roll-up, ranking and state mapping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.ranks import global_rank
from tallymark.sources.views import MONEY

c = F.col

# Score weights (risk counts inverted) and the status labels.
WEIGHTS = {"strategic_alignment": "0.35", "business_value": "0.30", "risk_level": "0.15", "resource_availability": "0.20"}
STATES = {"Draft": "draft", "Submitted": "submitted", "Approved": "approved", "Active": "active",
          "On Hold": "on_hold", "Closed": "closed"}


def portfolio_score(portfolios: DataFrame) -> DataFrame:
    def part(name: str):
        value = c(name).cast("decimal(5,0)")
        return (100 - value if name == "risk_level" else value) * F.lit(WEIGHTS[name]).cast("decimal(3,2)")

    total = sum((part(n) for n in list(WEIGHTS)[1:]), part("strategic_alignment"))
    return portfolios.withColumn("total_score", total.cast("decimal(9,2)"))


def portfolio_rollup(portfolios: DataFrame, projects: DataFrame) -> DataFrame:
    children = projects.groupBy("portfolio_id").agg(
        F.count("*").alias("project_count"), F.sum("budget_total").cast(MONEY).alias("budget_allocated"))
    return (portfolios.join(children, "portfolio_id", "left")
            .withColumns({"project_count": F.coalesce("project_count", F.lit(0)),
                          "budget_allocated": F.coalesce("budget_allocated", F.lit(0).cast(MONEY))})
            .withColumn("budget_remaining", (c("budget_total") - c("budget_allocated")).cast(MONEY)))


def portfolio_rank(portfolios: DataFrame) -> DataFrame:
    """Rank by score, whatever number of different scores there are."""
    return global_rank(portfolio_score(portfolios), "total_score", "score_rank").orderBy(c("priority").desc(), "name")


def state_map(portfolios: DataFrame, label: str = "status_label", current: str = "state") -> DataFrame:
    """Display status to code; an unknown or empty label keeps the current state."""
    mapping = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return portfolios.withColumn("new_state", F.coalesce(F.try_element_at(mapping, F.coalesce(label, F.lit(""))), current))


def inherit_account(projects: DataFrame, portfolios: DataFrame) -> DataFrame:
    """A project without an account takes its portfolio's."""
    parents = portfolios.select("portfolio_id", c("account_id").alias("parent_account"))
    return (projects.join(parents, "portfolio_id", "left")
            .withColumn("account_id", F.coalesce("account_id", "parent_account")).drop("parent_account"))


def skill_match(skills: DataFrame, required: list[str]) -> DataFrame:
    """Resources holding every required skill. Only matching rows are shuffled, folded per (resource, skill)."""
    held = skills.filter(c("skill").isin(required)).groupBy("resource_id").agg(F.countDistinct("skill").alias("held"))
    return held.filter(c("held") == len(set(required)))


def tenant_scope(df: DataFrame, column: str, tenant, strict: bool = False) -> DataFrame:
    """Rows of one tenant. Without a tenant: no rows, or an error when strict."""
    if tenant is None:
        if strict:
            raise ValueError("no tenant is set")
        return df.filter(F.lit(False))
    return df.filter(c(column) == F.lit(tenant))


def expired_rows(df: DataFrame, as_of, created: str, ttl_seconds: int = 86400, expires: str | None = None) -> DataFrame:
    """Rows past their expiry, or past ``created`` + TTL where no expiry is stored."""
    # the columns stay bare, so both bounds can reach the scan
    stale = c(created) <= F.lit(as_of - dt.timedelta(seconds=ttl_seconds))
    return df.filter((c(expires) <= F.lit(as_of)) | (c(expires).isNull() & stale) if expires else stale)
