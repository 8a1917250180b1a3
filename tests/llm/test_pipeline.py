"""The stages in order, each on its own input, and the whole run."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
from tallymark.session import shared_root
from tests.llm.test_operators import plain_components, words

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(path := f"{tmp_path}/{k}")
        docs = spark.read.parquet(path)
        if name != "best-fit packing":
            assert docs.columns == columns
            kept.append(docs.count())
        if name == "line dedup":
            assert kept[-1] == kept[-2]
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "minhash near-dedup":
            groups = plain_components(list(before.items()))
            assert {r.doc_id for r in docs.collect()} == {k for k, (_, c) in groups.items() if k == c}
    assert {r.doc_id for r in docs.collect()} == set(before)
    assert kept == sorted(kept, reverse=True) and kept[0] < 200
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.columns == docs.columns and whole.count() == docs.count()


def test_one_of_each_tells_rows_apart(spark):
    """Repeated rows and rows without an id: one of each group stays, and every row without words."""
    text, other, third = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(3, text), (3, text), (5, text), (None, other), (None, other), (7, third), (8, None), (8, None), (None, " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each(spark, docs, FOLDER)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted(
        [("3", text), ("None", other), ("7", third), ("8", "None"), ("8", "None"), ("None", " ")])


def test_one_of_each_writes_no_second_copy_of_the_texts(spark, tmp_path):
    def held():
        return sum(p.stat().st_size for p in Path(shared_root(spark).removeprefix("file:")).rglob("*.parquet"))

    rows = [(k, words(k % 90, 3000, 10**6), "en", "s", 1) for k in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    size, before = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")), held()
    got = corpus_pipeline.one_of_each(spark, spark.read.parquet(f"{tmp_path}/docs"), FOLDER)
    assert {r.doc_id for r in got.collect()} == set(range(90))
    assert held() - before < size / 2
