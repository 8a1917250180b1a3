"""Text files as a table: one row per file, then one row per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
# Folders that are skipped, and the binary test.
EXCLUDED_DIRS = (".git", "node_modules", "dist", "build", ".venv", "__pycache__", ".next")
TEXT_SHARE = 0.60
LINE_BREAK = r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085\u2028\u2029]"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` with path, length and content."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", "length", "content"))


def skip_reason(excluded: tuple[str, ...] = EXCLUDED_DIRS, max_bytes: int | None = None) -> Column:
    """Why a file is not scanned, or null: an excluded folder, a size above ``max_bytes`` (no limit
    unless given), a NUL byte, or under 60 % printable ASCII in the whole content."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    content = F.decode("content", "ISO-8859-1")
    printable = F.length(F.regexp_replace(content, r"[^\x09-\x0D\x20-\x7E]", ""))
    reason = F.when(F.arrays_overlap(folders, F.array(*map(F.lit, excluded))), "excluded folder")
    if max_bytes is not None:
        reason = reason.when(c("length") > max_bytes, "too large")
    return reason.when(content.contains("\x00"), "binary").when(
        printable.cast("double") < TEXT_SHARE * F.length(content), "not text")


def corpus_scan(files: DataFrame, excluded: tuple[str, ...] = EXCLUDED_DIRS, max_bytes: int | None = None) -> DataFrame:
    """(path, text) of the files worth scanning. Bytes that are no UTF-8 become replacement characters."""
    return (files.filter(skip_reason(excluded, max_bytes).isNull())
            .select("path", F.make_valid_utf8(c("content").cast("string")).alias("text")))


def corpus_skipped(files: DataFrame, excluded: tuple[str, ...] = EXCLUDED_DIRS, max_bytes: int | None = None) -> DataFrame:
    """(path, reason) of the files that ``corpus_scan`` leaves out."""
    return files.select("path", skip_reason(excluded, max_bytes).alias("reason")).filter("reason is not null")


def lines(corpus: DataFrame) -> DataFrame:
    """(path, line_no, line), line numbers from 1."""
    # the outer form, because the plain one would split every text twice
    return (corpus.filter(c("text").isNotNull()).select("path", F.posexplode_outer(F.split("text", LINE_BREAK)).alias("pos", "line"))
            .select("path", (c("pos") + 1).alias("line_no"), "line"))
