"""Time-series analytics on a dense daily spine, without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize

c = F.col
UNIT = "decimal(38,0)"


def dense_daily(df: DataFrame, day: Column, value: Column) -> DataFrame:
    """(day, value) with one row for every calendar day between first and last; gaps are 0.

    The daily rows, one per calendar day, are stored once: the spine, the lag and
    the latest day all read them, and none repeats the work behind them.
    """
    daily = materialize(df.groupBy(day.alias("day")).agg(value.alias("value")), "daily")
    spine = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("day"))
    return spine.join(daily, "day", "left").withColumn("value", F.coalesce("value", F.lit(0)))


def compare_lag(series: DataFrame, lag: int = 7) -> DataFrame:
    """Value beside the one ``lag`` days before and the change in percent (null without an earlier value)."""
    earlier = series.select(F.date_add("day", lag).alias("day"), c("value").alias("previous"))
    prev = F.when(c("previous") != 0, c("previous")).cast("double")
    return (series.join(earlier, "day", "left")
            .withColumn("change_pct", (c("value") - c("previous")).cast("double") / prev * 100.0))


def latest(series: DataFrame) -> DataFrame:
    newest = series.agg(F.max("day"))
    return series.filter(c("day") == newest.scalar())


def kpi_compare_lag(df: DataFrame, day: Column, value: Column, lag: int = 7) -> DataFrame:
    """The latest day's value against ``lag`` days earlier."""
    return latest(compare_lag(dense_daily(df, day, value), lag))


def kpi_anomaly(series: DataFrame, window: int = 7, limit: float = 3.0) -> DataFrame:
    """z-score against the ``window`` days before, flagged beyond ``limit``.

    Each day hands its value to the following days, so the trailing window is a
    plain aggregate. Sums run over whole hundredths and stay exact.
    """
    units = series.withColumn("x", (c("value") * 100).cast(UNIT))
    handed = (units.select(F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", window))).alias("day"), "x")
              .groupBy("day").agg(F.count("*").alias("n"), F.sum("x").cast(UNIT).alias("s"),
                                  F.sum((c("x") * c("x")).cast(UNIT)).cast(UNIT).alias("q")))
    n = c("n").cast("decimal(10,0)")
    spread = (n * c("q") - c("s") * c("s")).cast("double")
    sd_n = F.sqrt(spread / (c("n") * (c("n") - 1)).cast("double")) * c("n").cast("double")
    gap = (n * c("x") - c("s")).cast("double")
    z = F.when((c("n") >= 2) & (spread > 0), gap / F.when((c("n") >= 2) & (spread > 0), sd_n))
    return (units.join(handed, "day", "left").withColumn("z", F.round(z, 6))
            .withColumn("is_anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))
            .select("day", "value", "z", "is_anomaly"))


def share_of_total(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Per-group value and its share; the total is a scalar over the grouped rows."""
    grouped = df.groupBy(*keys).agg(value.alias("value"))
    total = grouped.agg(F.nullif(F.sum("value").cast("double"), F.lit(0.0)))
    return grouped.withColumn("share", c("value").cast("double") / total.scalar())
