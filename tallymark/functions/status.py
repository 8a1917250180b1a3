"""Status rules: project health and final-pay SLA, plus their SQL functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

INTERNAL_DAYS = 7
STATUTORY_DAYS = 30


def health_status(cpi: Column, spi: Column) -> Column:
    return (F.when((cpi >= F.lit("0.95").cast("decimal(4,2)")) & (spi >= F.lit("0.95").cast("decimal(4,2)")), "GREEN")
            .when((cpi >= F.lit("0.85").cast("decimal(4,2)")) & (spi >= F.lit("0.85").cast("decimal(4,2)")), "YELLOW")
            .otherwise("RED"))


def sla_status(executed: Column, due: Column, as_of: dt.date) -> Column:
    """In this order: late and open, due within a day, paid in time, paid late, otherwise pending."""
    today = F.lit(as_of)
    return (F.when(executed.isNull() & (today > due), "breach")
            .when(executed.isNull() & (today > F.date_sub(due, 2)), "at_risk")
            .when(executed.isNotNull() & (executed <= due), "compliant")
            .when(executed.isNotNull() & (executed > due), "breach")
            .otherwise("pending"))


def statutory_compliant(executed: Column, days: Column) -> Column:
    """True up to 30 days, false beyond, null while unknown."""
    return F.when(executed.isNotNull() & days.isNotNull(), days <= STATUTORY_DAYS)


def register_sql_functions(spark: SparkSession) -> None:
    """Expose the rules to Spark SQL users."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION js_or(v DOUBLE, d DOUBLE) RETURNS DOUBLE "
              "RETURN CASE WHEN v IS NULL OR v = 0 THEN d ELSE v END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION health_status(cpi DECIMAL(20,3), spi DECIMAL(20,3)) RETURNS STRING "
              "RETURN CASE WHEN cpi >= 0.95 AND spi >= 0.95 THEN 'GREEN' "
              "WHEN cpi >= 0.85 AND spi >= 0.85 THEN 'YELLOW' ELSE 'RED' END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sla_status(executed DATE, due DATE, as_of DATE) RETURNS STRING "
              "RETURN CASE WHEN executed IS NULL AND as_of > due THEN 'breach' "
              "WHEN executed IS NULL AND as_of > date_sub(due, 2) THEN 'at_risk' "
              "WHEN executed <= due THEN 'compliant' WHEN executed > due THEN 'breach' ELSE 'pending' END")
