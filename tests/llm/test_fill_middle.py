"""Fill-in-the-middle against plain slicing, exact round trips, and its defined results at the edges."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.llm.fill_middle import Blocks, fill_in_middle, restored

ALPHABET = "ab c\n\t<PSM>éß漢字🙂́"


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def plain(doc_id, text):
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[i:i + 8], 16) for i in range(0, 32, 8)]
    text = text or ""
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_outputs_and_round_trip(spark):
    rows = list(enumerate(texts(1, 400)))
    cut = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), block=16)
    got = {r.doc_id: r for r in cut.withColumn("back", restored()).collect()}
    assert {k: tuple(got[k][c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) for k, _ in rows} == {
        k: plain(k, t) for k, t in rows}
    assert all(got[k].back == t for k, t in rows)
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_edges(spark):
    long = "漢x🙂 " * 300_000
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "ab"), (7, "a<P>b"), (8, long), (9, "<" * 50 + "S" * 50), (11, "<P><S><M>")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("n", "form", "output", "prefix_chars", "middle_chars")})
    got = fill_in_middle(table).withColumn("back", restored()).collect()
    assert sorted(map(str, [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got])) == sorted(
        map(str, [(k, *plain(k, t)) for k, t in rows]))
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        fill_in_middle(table, unit="line")


@pytest.mark.parametrize("block", [1, 3, 8, 512])
def test_every_boundary_of_code_points(block):
    for text in [*texts(2, 40), "🙂" * 40, ""]:
        blocks = Blocks(text.encode(), block=block)
        assert blocks.n == blocks.chars == len(text)
        assert [blocks.cut(k) for k in range(len(text) + 2)] == [
            (len(text[:k].encode()), min(k, len(text))) for k in range(len(text) + 2)]


@pytest.mark.parametrize("block", [2, 16, 512])
def test_every_boundary_of_words(block):
    for text in [*texts(3, 40), "  lead", " \n ", "one", "a" * 99 + " b", ""]:
        units = re.findall(r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", text) or ([text] if text else [])
        blocks = Blocks(text.encode(), "word", block)
        assert blocks.n == len(units)
        ends = ["".join(units[:k]) for k in range(len(units) + 1)]
        assert [blocks.cut(k) for k in range(len(units) + 1)] == [(len(e.encode()), len(e)) for e in ends]


def test_words_as_units(spark):
    rows = list(enumerate(texts(5, 60)))
    cut = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit="word", seed=7).withColumn("back", restored())
    got = {r.doc_id: r for r in cut.collect()}
    assert all(got[k].back == t for k, t in rows)
    for r in got.values():
        if r.form == "psm":
            prefix = r.output[3:3 + r.prefix_chars]
            assert prefix == "" or prefix.isspace() or prefix[-1] in " \t\n" or r.prefix_chars == len(r.back)
