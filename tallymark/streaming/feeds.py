"""Change feeds as Structured Streaming jobs.

Every job runs with ``availableNow`` by default: it processes what is new and
stops, and a scheduler outside starts it again on the same folder, where the
stream's checkpoint and the tables of ``stores`` lie. State lives in files of the
shared folder, never on one machine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymark.operators.changes import budget_audit_rows, upsert_latest
from tallymark.operators.quality import WORKFLOW_TYPES
from tallymark.session import materialize, release, work_dir
from tallymark.streaming.stores import FOLD_EVERY, Outputs, Snapshot

c = F.col


def change_feed_source(spark: SparkSession, path: str, schema: str, max_files: int | None = None,
                       time_column: str | None = "ts") -> DataFrame:
    """A file-fed stream of change rows; the event time becomes an absolute timestamp.

    ``path`` may be a folder or one file: as a pattern it names either, while a
    plain path would have to be a folder.
    """
    if not any(ch in path for ch in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.parquet(path)
    return df.withColumn(time_column, c(time_column).cast("timestamp")) if time_column else df


def kafka_feed_source(spark: SparkSession, servers: str, topics: list[str], schema: str,
                      max_rows: int | None = None) -> DataFrame:
    """The production form: JSON change rows from one topic per table. ``max_rows`` bounds a micro-batch."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    raw = (reader if max_rows is None else reader.option("maxOffsetsPerTrigger", max_rows)).load()
    return raw.select(c("topic").alias("table"), F.from_json(c("value").cast("string"), schema).alias("row")).select("table", "row.*")


def run_job(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None], trigger: dict | None = None) -> None:
    """Give every new micro-batch and its number to ``step``, then stop; the next start goes on from there."""
    query = (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()


def append_stream(stream: DataFrame, label: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df,
                  trigger: dict | None = None) -> DataFrame:
    """Run a stateless stream into the file sink and read the table back."""
    folder = work_dir(stream.sparkSession, label)
    out = transform(stream)
    query = (out.writeStream.format("parquet").option("path", f"{folder}/data")
             .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
             .trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(f"{folder}/data")


def stream_upsert(stream: DataFrame, keys: list[str], order: list[str], folder: str | None = None,
                  fold_every: int = FOLD_EVERY) -> DataFrame:
    """Latest row per key, kept in a versioned snapshot; start it again on its folder to take in what is new.

    Neither a late row nor a replayed batch changes the outcome, as the last write is told by ``order``.
    """
    spark = stream.sparkSession
    folder = folder or work_dir(spark, "upsert")
    table = Snapshot(spark, f"{folder}/table", stream.schema, lambda df: upsert_latest(df, keys, order), fold_every)
    run_job(stream, folder, table.apply)
    return table.read()


def stream_budget_audit(stream: DataFrame, changes: Callable[[DataFrame], DataFrame], keys: list[str], order: str,
                        folder: str | None = None) -> DataFrame:
    """An audit row per budget change, as a trigger on the table writes it: the first change of a key to arrive creates it.

    ``changes`` turns a micro-batch into change rows. The keys that have been
    created, and the batch that did it, are a snapshot; a batch looks up only its
    own keys. A replayed batch ignores what it has itself stored, so it writes the
    same rows into its own folder again.
    """
    spark = stream.sparkSession
    folder = folder or work_dir(spark, "budget_audit")
    empty = changes(spark.createDataFrame([], stream.schema))
    created = StructType([f for f in empty.schema if f.name in keys]).add("first_batch", "long")
    known = Snapshot(spark, f"{folder}/known", created, lambda df: df.groupBy(*keys).agg(F.min("first_batch").alias("first_batch")))
    audit = budget_audit_rows(empty, order, F.lit(True)).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(changes(batch), "changes")
        first = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
        new = materialize(first.join(known.read().filter(c("first_batch") < batch_id), keys, "left_anti"), "created")
        is_first = F.coalesce(c(order) == c("_first"), F.lit(False))
        budget_audit_rows(rows.join(new, keys, "left"), order, is_first).write.mode("overwrite").parquet(f"{folder}/audit/batch_id={batch_id}")
        known.apply(new.select(*keys, F.lit(batch_id).cast("long").alias("first_batch")), batch_id)
        release(rows, new)

    run_job(stream, folder, step)
    return spark.read.schema(audit).parquet(f"{folder}/audit").select(*audit.names)


def stream_large_invoices(stream: DataFrame, minimum: int = 10000) -> DataFrame:
    return append_stream(stream, "alerts", lambda df: df.filter(c("amount_total") >= minimum))


def drift_alerts(log: DataFrame) -> DataFrame:
    """Inserted drift rows with status 'drift_found', as notifications."""
    return log.filter(c("status") == "drift_found").select(
        "id", "environment", F.concat(F.lit("Drift in "), "environment").alias("title"),
        F.lit("Dashboard configuration has drifted").alias("body"), F.concat(F.lit("/drift/"), c("id").cast("string")).alias("url"),
        "checked_at")


def audit_rows(events: DataFrame) -> DataFrame:
    """Workflow events as audit rows; ``accepted`` is false outside the declared workflow types."""
    return events.select(
        "event_id", "company_id", "workflow_type", "source_system", "source_record_id", "action",
        F.to_json(F.struct(c("props").alias("props"))).alias("metadata"), "created_at",
        F.coalesce(c("workflow_type").isin(*WORKFLOW_TYPES), F.lit(False)).alias("accepted"))


AUDIT_SINKS = ("accepted", "quarantine")


def split_audit(log: DataFrame) -> DataFrame:
    """Names the sink of each row: rows of an undeclared workflow type are kept apart, not dropped."""
    return log.withColumn("sink", F.when(c("accepted"), AUDIT_SINKS[0]).otherwise(AUDIT_SINKS[1])).drop("accepted")


def stream_audit_log(stream: DataFrame, folder: str | None = None) -> Outputs:
    """Workflow events into two tables, accepted and quarantined, under one ledger."""
    spark = stream.sparkSession
    folder = folder or work_dir(spark, "audit")
    schema = split_audit(audit_rows(spark.createDataFrame([], stream.schema))).drop("sink").schema
    out = Outputs(spark, folder, schema, AUDIT_SINKS)
    run_job(stream, folder, lambda batch, batch_id: out.write(batch_id, split_audit(audit_rows(batch))))
    return out


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Counts per type and tumbling window; a window appears once the watermark has passed its end."""
    return (stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), kind)
            .agg(F.count("*").alias("n"))
            .select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), kind, "n"))
