"""The corpus pipeline: each stage reads what its predecessor kept, written as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.decontaminate import decontaminate
from tallymark.llm.line_dedup import line_dedup
from tallymark.llm.minhash import near_duplicates
from tallymark.llm.packing import best_fit
from tallymark.llm.quality import GOOD, GRADES, classify, graded, train
from tallymark.llm.queries import prepared
from tallymark.llm.sieve import sieve
from tallymark.session import materialize, work_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Trained models, hash families and token ids are not for SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably good stay; toxic ones and those of low quality go."""
    prepared(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = classify(docs, train(docs, graded(labels), GRADES), GOOD)
    return rated.filter("kept").select(*COLUMNS)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three lines in a row go; every document stays, with its new length."""
    prepared(spark)
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id. Of rows alike in id and text any one stays.

    Only rows that go, or that are alike in id and text with one that goes, are looked for by a join.
    """
    prepared(spark)
    found = near_duplicates(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")) \
        .agg(F.max("kept").alias("stays"), F.min("kept").alias("all_stay")).filter("not all_stay").drop("all_stay")
    found = materialize(found, "near_copies")
    docs = docs.select(*COLUMNS)
    touched = sieve(found, "hash")(F.xxhash64("text"))
    maybe = docs.filter(touched)
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.xxhash64("text"))
    one = maybe.join(found.filter("stays"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.filter(~touched).union(maybe.join(found, same, "left_anti")).union(one)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepared(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token piece of every document in a training sequence."""
    prepared(spark)
    return best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), special=True)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("minhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
