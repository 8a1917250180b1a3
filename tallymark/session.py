"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from measured sizes, so no operator forces a broadcast on
# data that grows; skewed join partitions are split even when that costs one
# more shuffle later in the plan.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
_APPLIED = "spark.tallymark.settings.applied"
# Only at start: skip the call-site record PySpark makes for every Column call.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **START_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime options, once, on a session somebody else created."""
    if spark.conf.get(_APPLIED, None) is None:
        for key, value in {**SETTINGS, _APPLIED: "true"}.items():
            spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: one that the driver and all executors see.

    ``spark.checkpoint.dir`` names it; where that is unset, a folder in the
    session's warehouse serves, which Spark shares as well. It is removed when
    the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    root = f"{root.rstrip('/')}/tallymark-{spark.conf.get('spark.app.id')}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return root


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing will read again.

    The shuffle files of finished jobs go as well: Spark drops them when the
    driver's garbage collector finds that no plan holds them, so it is asked to look.
    """
    spark = tables[0].sparkSession
    for table in tables:
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()
