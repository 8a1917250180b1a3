"""Line dedup with overlapping windows of three lines.

A window is three consecutive lines. Of all places where it stands, the first
stays: the smallest document id, then the smallest position. Each later place
covers its three lines, the covered positions of a document are merged, and the
lines at them go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize

WINDOW = 3
KEY = ["doc", "text_hash"]


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_hash, pos, a, b): the 96-bit key of each window; the text itself stays where it is."""
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                        F.split(F.col(text_col), "\n").alias("l"))

    def key(i):
        parts = [F.get("l", i + k) for k in range(WINDOW)]
        return F.struct(F.xxhash64(*parts).alias("a"), F.hash(*parts).alias("b"))

    places = F.when(F.size("l") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), key))
    return lines.select(*KEY, F.posexplode(places).alias("pos", "w")).select(*KEY, "pos", "w.a", "w.b")


def covered_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, covered): the line numbers that go, for each document that loses some."""
    windows = materialize(_windows(docs, id_col, text_col), "windows")
    # A null id comes last. Rows alike in id and text are one place.
    place = F.struct(F.col("doc").isNull().alias("none"), *KEY, "pos")
    repeated = materialize(
        windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter("first != last").drop("last"), "repeated")
    same = F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.text_hash") == F.col("text_hash"))
    # A later place that overlaps the first one in its own document leaves that one whole.
    start = F.when(same, F.greatest(F.col("pos"), F.col("first.pos") + WINDOW)).otherwise(F.col("pos"))
    later = windows.join(repeated, ["a", "b"]).filter(~(same & (F.col("first.pos") == F.col("pos"))))
    spans = later.select(*KEY, start.alias("start"), (F.col("pos") + WINDOW - 1).alias("end")).filter("start <= end")
    return spans.select(*KEY, F.explode(F.sequence("start", "end")).alias("line")) \
        .groupBy(*KEY).agg(F.collect_set("line").alias("covered"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines gone from the text, and ``n_lines`` and ``n_removed``.

    Lines end at a line feed and are compared as they are. A text of fewer than
    three lines has no window and stays, also an empty one; a null text stays
    null with zero lines. A text that only repeats others becomes empty. Rows alike
    in id and text are one document, and each such row gets the same result; rows
    with one id and different texts are different documents, in the order of
    their hashes. A null id comes after all others. All other columns stay as
    they are, whatever their names (``n_lines`` and ``n_removed`` are replaced).
    Windows are equal where their 96-bit keys are; the lines themselves are not compared again.
    """
    covered = covered_positions(docs, id_col, text_col).select(
        F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("covered").alias("__covered"))
    joined = docs.join(covered, F.col(id_col).eqNullSafe(F.col("__doc"))
                       & (F.xxhash64(F.col(text_col)) == F.col("__hash")), "left")
    joined = joined.withColumn("__lines", F.split(F.col(text_col), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__covered"))
    rest = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    out = joined.withColumns({
        text_col: F.when(F.col("__covered").isNull(), F.col(text_col)).otherwise(rest),
        "n_lines": F.coalesce(F.array_size("__lines"), F.lit(0)),
        "n_removed": F.coalesce(F.array_size("__covered"), F.lit(0))})
    return out.drop("__doc", "__hash", "__covered", "__lines")
