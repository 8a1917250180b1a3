"""External tables, ad-hoc SQL, tables and views from a query, idempotent loads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.plans.periods import between
from tallymark.session import work_dir
from tallymark.sources.tables import SCHEMAS

DEFAULT_START = dt.date(2024, 1, 1)


def external_table_scan(spark: SparkSession, path: str, name: str, date_column: str,
                        start: dt.date = DEFAULT_START) -> DataFrame:
    """Files outside the catalog with declared columns, from a start date on.

    The bound is typed like the column, so it reaches the Parquet row groups.
    """
    return between(spark.read.schema(SCHEMAS[name]).parquet(path), date_column, start, None)


def jdbc_table_scan(spark: SparkSession, url: str, table: str, date_column: str, start: dt.date = DEFAULT_START,
                    **options: str) -> DataFrame:
    """The same over JDBC; Spark sends the predicate to the database."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return between(df, date_column, start, None)


def ad_hoc_sql(spark: SparkSession, text: str, views: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Run SQL text over the given views, with an optional row limit."""
    df = spark.sql(text, **views)
    return df if limit is None else df.limit(limit)


def create_table_as(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Store a query result as files in the shared folder and read it back."""
    path = work_dir(df.sparkSession, label)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_view_as(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key (null keys match each other)."""
    values = [x for x in incoming.columns if x not in key]
    once = incoming.groupBy(*key).agg(F.min(F.struct(*values)).alias("_v")).select(*key, "_v.*") if values else \
        incoming.dropDuplicates(key)
    old = stored.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = [once[k].eqNullSafe(old[f"_{k}"]) for k in key]
    return once.join(old, same, "left_anti").select(*incoming.columns)


def idempotent_load(spark: SparkSession, path: str, incoming: DataFrame, key: list[str]) -> int:
    """Append only what is missing below ``path``; running it again adds nothing."""
    stored = spark.read.schema(incoming.schema).parquet(path)
    fresh = insert_if_absent(stored, incoming, key)
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(incoming.schema).parquet(path).count()
