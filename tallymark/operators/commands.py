"""Command logs: classification, enforcement and adoption figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.joins import join_null_safe
from tallymark.operators.quantiles import exact_quantiles

c = F.col

# Command patterns per class in checking order, and the excluded programs.
CLASSES = {
    "file_read": (r"^cat\s+", r"^head\s+", r"^tail\s+", r"^less\s+", r"^more\s+"),
    "file_search": (r"^find\s+", r"^locate\s+", r"^ls\s+.*-R"),
    "content_search": (r"^grep\s+", r"^rg\s+", r"^ag\s+", r"^ack\s+"),
    "file_edit": (r"^sed\s+", r"^awk\s+", r"^perl\s+-[pi]"),
    "file_write": (r"^echo\s+.*>", r"^printf\s+.*>", r"^cat\s+<<"),
}
EXCLUDED = (r"^git\s+", r"^docker\s+", r"^npm\s+", r"^make\s+", r"^ssh\s+")
# What each enforcement level does.
ACTIONS = {"advisory": "info", "warning": "warn", "confirmation": "confirm", "strict": "block"}


def command_class(command: Column) -> Column:
    """Class of a command; excluded programs first, null when nothing fits."""
    out = F.when(command.rlike("|".join(EXCLUDED)), F.lit(None).cast("string"))
    for name, patterns in CLASSES.items():
        out = out.when(command.rlike("|".join(patterns)), name)
    return out


def command_classify(log: DataFrame) -> DataFrame:
    return log.withColumn("detected_as", command_class(c("command")))


def enforcement_level(log: DataFrame) -> DataFrame:
    """What happens to a detected command under its level; undetected ones pass."""
    table = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return command_classify(log).withColumn(
        "action", F.when(c("detected_as").isNull(), "pass").otherwise(F.try_element_at(table, c("level"))))


def tool_adoption(log: DataFrame) -> DataFrame:
    """Per phase: share of each tool kind, fallback and error rate, exact p99 of the detection time."""
    n = F.count("*").cast("double")

    def share(condition: Column) -> Column:
        return F.count_if(condition).cast("double") / n

    rates = log.groupBy("phase").agg(
        F.count("*").alias("operations"), *[share(c("tool_kind") == k).alias(f"{k}_share") for k in ("mcp", "builtin", "shell")],
        share(c("fallback_used")).alias("fallback_rate"), share(c("failed")).alias("error_rate"))
    return join_null_safe(rates, exact_quantiles(log, ["phase"], "detect_us", {"p99_us": 0.99}), ["phase"], "left")
