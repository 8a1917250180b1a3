"""Small text files in shared storage, through the file systems that Spark itself uses."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of ``folder``, sorted; none if it does not exist."""
    files, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _at(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that readers see whole or not at all. A file that is there already stays as it is."""
    files, where = _at(spark, path)
    if files.exists(where):
        return
    folder, _, name = path.rpartition("/")
    _, draft = _at(spark, f"{folder}/_{name}-{uuid.uuid4().hex}")
    stream = files.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not files.rename(draft, where):
        files.delete(draft, False)
        if not files.exists(where):
            raise OSError(f"{path} could not be written")


def remove(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)
