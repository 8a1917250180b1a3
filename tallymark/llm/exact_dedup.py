"""Exact duplicates by content-defined chunk recipes.

A text, freed of white space, is cut where its content says so. Every distinct
chunk of the corpus moves once, to prove that the chunk identifiers tell all
chunks apart. A document is then its recipe, the ordered list of identifiers:
about sixteen bytes for each few hundred characters, and all that later steps move.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize, release

WHITE = r"[\x20\x09-\x0D]+"


def _every(step: int, low: int, high: int) -> str:
    """A character class: one eighth of the code points from ``low`` on, in runs that are ``step`` apart."""
    width = max(step // 8, 1)
    return "".join(f"\\x{{{at:x}}}" + (f"-\\x{{{at + width - 1:x}}}" if width > 1 else "") for at in range(low + 5 * width, high, step))


# A cut falls after three characters of a class that holds an eighth of every script, at least 256 and at most 4096
# characters after the one before. Letters of alphabets count by themselves, ideographs, syllables and signs in runs.
# Each range has its own part, so that a letter is not compared with those of other scripts.
_PARTS = ((r"\x{100}-\x{10FF}", _every(8, 0x100, 0x1100)), (r"\x{3040}-\x{30FF}", _every(8, 0x3040, 0x3100)),
          (r"\x{1100}-\x{303F}\x{3100}-\x{1EFFF}", _every(512, 0x1100, 0x3040) + _every(512, 0x3100, 0x1F000)),
          (r"\x{1F000}-\x{1FFFF}", _every(64, 0x1F000, 0x20000)), (r"\x{20000}-\x{10FFFF}", _every(4096, 0x20000, 0x110000)))
_CUT = "[" + _every(8, 0x20, 0x100) + "".join(f"[[{span}]&&[{own}]]" for span, own in _PARTS) + "]"
CHUNK = f"(?s).{{253,4093}}?{_CUT}{{3}}|.{{1,4096}}"


def normalised(text: Column) -> Column:
    """The text without white space; a null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def chunk_hash(chunk: Column, seed: int) -> Column:
    """128 bits; ``seed`` gives another function."""
    return F.struct(F.xxhash64(F.lit(seed), chunk).alias("a"), F.xxhash64(chunk, F.lit(seed)).alias("b"))


def verified_seed(pieces: DataFrame, identify: Callable[[Column, int], Column] = chunk_hash) -> int:
    """The first seed whose identifiers are one to one on the column ``chunk`` of ``pieces``.

    Equal chunks meet on the map side already, so a chunk that a third of all
    documents hold is one row per task.
    """
    distinct = pieces.select("chunk").distinct()
    for seed in count():
        clash = distinct.groupBy(identify(F.col("chunk"), seed).alias("id")).count().filter("count > 1")
        if clash.isEmpty():
            return seed


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 identify: Callable[[Column, int], Column] = chunk_hash) -> DataFrame:
    """One row per row of ``docs`` with the row that stays for it.

    Texts are equal when they are identical without white space. Of equal texts
    the one with the most code points in the original stays, then the smallest
    id. A null text counts as empty, and all empty texts are equal. A null id
    comes after all others. Rows alike in id and length tie; exactly one of them
    is kept. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("norm", normalised(F.col("text")))
    # cutting is the dear part, so it is done once and the pieces are stored
    cut = materialize(texts.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.length("text").alias("n_points"),
        F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks")), "chunks")
    seed = verified_seed(cut.select(F.explode("chunks").alias("chunk")), identify)
    recipes = materialize(cut.withColumn("recipe", F.transform("chunks", lambda c: identify(c, seed))).drop("chunks"), "recipes")
    release(cut)
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    groups = recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    shared = materialize(groups.filter("group_size > 1").select(
        F.col("recipe").alias("shared"), "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")),
        "groups")
    alone = F.col("shared").isNull()
    return recipes.join(shared, F.col("recipe") == F.col("shared"), "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")
