"""Properties and brute-force comparisons on small random data with hot keys."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import changes, quality, quantiles, ranks, tree
from tallymark.operators.capability import determinism_hash
from tallymark.operators.finance import latest_snapshot
from tallymark.operators.quantiles import boxplot, exact_quantiles
from tallymark.operators.series import kpi_anomaly, share_of_total
from tallymark.operators.tree import tree_expand
from tallymark.registry import queries
from tallymark.sources import catalog_json, corpus, warehouse

SMALL = "/root/testdata/sf0.001"


def test_upsert_does_not_depend_on_order(spark):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 2, 3]), i % 50, i, rng.random()) for i in range(400)]
    shuffled = data[:]
    rng.shuffle(shuffled)
    schema = "k int, ts int, id int, v double"
    got = [sorted(map(tuple, changes.upsert_latest(spark.createDataFrame(d, schema), ["k"], ["ts", "id"]).collect())) for d in (data, shuffled)]
    want = {k: max((r for r in data if r[0] == k), key=lambda r: (r[1], r[2])) for k in (1, 2, 3)}
    assert got[0] == got[1] == sorted(want.values())


def plain_lag(data):
    """{id: (kind before, microseconds since)} by sorting all events of a key."""
    want = {}
    for k in {r[0] for r in data}:
        ordered = sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2]))
        for before, r in zip([None, *ordered], ordered):
            want[r[2]] = (None, None) if before is None else (before[3], int((r[1] - before[1]).total_seconds() * 1_000_000))
    return want


TIMED = "k int, t timestamp, id int, kind string"


@pytest.mark.parametrize("step", [7, 5000])
def test_timeline_equals_a_plain_lag(spark, step):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    data = [(rng.choice([1, 1, 1, 1, 2, 3]), start + dt.timedelta(seconds=rng.randrange(0, 40000, step)), i, rng.choice("abc")) for i in range(600)]
    df = spark.createDataFrame(data, TIMED)
    assert {r.id: (r.previous, r.micros_since) for r in changes.timeline(df, ["k"], "t", "id", "kind").collect()} == plain_lag(data)
    assert changes.timeline(df.filter("false"), ["k"], "t", "id", "kind").collect() == []


def test_timeline_of_one_key_in_one_second_is_spread(spark, monkeypatch):
    """All events of a hot key share one moment; no range, and so no task, gets more than a part of them."""
    sizes = []
    real = changes.into_ranges

    def seen(*arguments):
        out = real(*arguments)
        sizes.extend(r["count"] for r in out.groupBy("_range").count().collect())
        return out

    monkeypatch.setattr(changes, "into_ranges", seen)
    moment = dt.datetime(2024, 1, 1)
    data = [(1, moment, i, "abc"[i % 3]) for i in range(8000)] + [(2, moment, 9000 + i, "z") for i in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: (r.previous, r.micros_since) for r in changes.timeline(spark.createDataFrame(data, TIMED), ["k"], "t", "id", "kind").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_lag(data)
    assert len(sizes) == 8 and max(sizes) < 2 * len(data) / 8


def test_ranks_of_fractional_scores(spark):
    rng = random.Random(6)
    scores = [round(rng.random() * 40, rng.randrange(1, 9)) for _ in range(3000)] + [7.25] * 900 + [None] * 5
    df = spark.createDataFrame(list(enumerate(scores)), "id int, score double")
    got = {r.id: r["rank"] for r in ranks.global_rank(df, "score", "rank").collect()}
    known = sorted((x for x in scores if x is not None), reverse=True)
    place = {}
    for at, x in enumerate(known, 1):
        place.setdefault(x, at)
    assert got == {k: place.get(x, len(known) + 1) for k, x in enumerate(scores)}
    assert ranks.global_rank(df.filter("false"), "score", "rank").collect() == []


def test_latest_snapshot_keeps_ties(spark):
    data = [(1, 1, "a"), (1, 3, "b"), (1, 3, "c"), (2, 5, "d")]
    df = spark.createDataFrame(data, "k int, day int, v string")
    assert sorted(r.v for r in latest_snapshot(df, ["k"], "day").collect()) == ["b", "c", "d"]
    assert sorted(r.v for r in latest_snapshot(df, ["k"], "day", unique=True).collect()) == ["b", "c", "d"]


def test_quantiles_of_values_close_together(spark, monkeypatch):
    """Times in microseconds and tiny values fall into one cell of fixed width, which is split by its own bounds."""
    monkeypatch.setattr("tallymark.operators.quantiles.VALUES", 20)
    values = {"t": [1.7e15 + 37 * k for k in range(3000)], "s": [1e-7 * k * k for k in range(2000)], None: [5.0] * 40 + [5.0 + 1e-9],
              "i": [float("-inf"), 1.0, 2.0, float("inf"), float("inf")]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 0.999}).collect()}
    for g in ("t", "s", None):
        for name, p in (("low", 0.1), ("mid", 0.5), ("top", 0.999)):
            assert got[g][name] == pytest.approx(float(np.quantile(values[g], p)), rel=1e-12, abs=1e-15)
    assert (got["i"].mid, got["i"].top) == (2.0, float("inf"))
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    assert exact_quantiles(nan, [], "v", {"mid": 0.5}).first().mid == 2.0  # a NaN is the largest value


@pytest.mark.parametrize("accuracy,slacks", [(5000, None), (40, None), (4, [0.0])])
def test_quantiles_equal_numpy(spark, accuracy, slacks):
    """A coarse sketch keeps more values; one whose bounds leave nothing misses, and the gap is read again."""
    rng = np.random.default_rng(3)
    groups = {"hot": rng.lognormal(3, 4, 5000).round(4), "flat": np.full(40, 7.5), "one": np.array([-3.25]), "two": np.array([1.0, 2.0]),
              "neg": -rng.exponential(1000, 300).round(2), "mix": np.array([-1e9, 0.0, 0.0, 1e-3, 5.0, 1e12])}
    groups[None] = np.array([4.0, 8.0, 9.0])
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None)], "g string, v double").repartition(5)
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q99": 0.99, "q4": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, accuracy, slacks).collect()}
    for g, vs in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("accuracy,slacks", [(5000, None), (30, None), (3, [0.0])])
def test_boxplot_equals_numpy(spark, accuracy, slacks):
    rng = np.random.default_rng(8)
    groups = {"hot": rng.lognormal(1, 1, 4000).round(3), "normal": rng.normal(0, 5, 900), "flat": np.full(30, 2.5), "one": np.array([4.0]),
              "far": np.array([0.0, 1, 2, 3, 4, 500, -500]), "wide": np.array([-1.7e308, 0.0, 1.0, 1.7e308]), None: np.array([1.0, 2.0, 9.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None)], "g string, v double").repartition(4)
    got = {r.g: r for r in boxplot(df, "g", "v", accuracy, slacks).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        r = got[g]
        if g != "wide":
            q1, q3 = (float(np.quantile(vs, p)) for p in (0.25, 0.75))
            assert (r.q1, r.q3) == (pytest.approx(q1, rel=1e-12, abs=1e-12), pytest.approx(q3, rel=1e-12, abs=1e-12))
        low, high = r.q1 - 1.5 * (r.q3 - r.q1), r.q3 + 1.5 * (r.q3 - r.q1)
        inside = [v for v in vs if low <= v <= high]
        assert (r.whisker_low, r.whisker_high, r.outliers, r.n_points) == (min(inside), max(inside), len(vs) - len(inside), len(vs))


def test_boxplot_keeps_no_copy_of_the_column(spark, monkeypatch):
    """What the second pass leaves is a small share of the rows."""
    stored = []
    real = quantiles.materialize

    def seen(df, label):
        out = real(df, label)
        stored.append((label, out.count()))
        return out

    monkeypatch.setattr(quantiles, "materialize", seen)
    df = spark.range(200_000).selectExpr("CAST(id % 2 AS STRING) AS g", "CAST(xxhash64(id) AS DOUBLE) AS v")
    boxplot(df, "g", "v", 1000).collect()
    assert "folded" in dict(stored) and max(n for _, n in stored) < 0.05 * 200_000


def test_tree_against_a_walk(spark):
    rng = random.Random(4)
    parents = {0: None, **{i: rng.choice([0, max(0, i - 1), rng.randrange(i)]) for i in range(1, 200)}, 500: 499}
    nodes = spark.createDataFrame([(str(k), None if p is None else str(p), f"n{k}") for k, p in parents.items()],
                                  "id string, parent_id string, label string")

    def trail(k):
        out = []
        while k is not None and k in parents:
            out.append(k)
            k = parents[k]
        return out[::-1]

    sizes = {k: sum(k in trail(j) for j in parents) for k in parents}
    for r in tree_expand(nodes).collect():
        k = int(r.id)
        assert r.path == " > ".join(f"n{x}" for x in trail(k))
        assert (r.subtree_size, r.is_leaf, r.is_orphan) == (sizes[k], sizes[k] == 1, k == 500)


def test_cycles_are_returned_as_rows(spark):
    """A ring of three, a tail below it, a node that is its own parent, and a whole tree beside them."""
    parents = {"a": "c", "b": "a", "c": "b", "d": "a", "e": "d", "s": "s", "r": None, "x": "r", "y": "x", "o": "gone"}
    nodes = spark.createDataFrame([(k, p, k) for k, p in parents.items()], "id string, parent_id string, label string")
    got = {r.id: r for r in tree_expand(nodes).collect()}
    assert set(got) == set(parents)
    for k in "abcdes":
        assert got[k].is_cycle and (got[k].depth, got[k].path, got[k].subtree_size) == (None, None, None)
    assert {k: (got[k].depth, got[k].path, got[k].subtree_size, got[k].is_orphan) for k in "rxyo"} == {
        "r": (0, "r", 3, False), "x": (1, "r > x", 2, False), "y": (2, "r > x > y", 1, False), "o": (0, "o", 1, True)}
    assert [k for k in got if got[k].is_leaf] and not got["d"].is_leaf and got["e"].is_leaf


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Every round writes one row per node, and a chain of n nodes takes log2(n) of them."""
    rounds = []
    real = tree.materialize

    def counted(df, label):
        out = real(df, label)
        rounds.append(out.count())
        return out

    monkeypatch.setattr(tree, "materialize", counted)
    n = 700
    nodes = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id", "CONCAT('n', id) AS label")
    got = {r.id: r for r in tree_expand(nodes).collect()}
    assert set(rounds) == {n} and len(rounds) <= 12
    assert all(got[k].depth == k and got[k].subtree_size == n - k for k in range(n))
    assert got[n - 1].path == " > ".join(f"n{k}" for k in range(n))


def test_a_root_with_most_of_the_nodes(spark):
    nodes = spark.range(5000).selectExpr("id", "CASE WHEN id > 0 THEN IF(id % 3 = 0, id - 1, 0) END AS parent_id", "'x' AS label")
    got = {r.id: r for r in tree_expand(nodes).collect()}
    assert len(got) == got[0].subtree_size == 5000 and got[2].subtree_size == 2 and got[3].depth == 2


def test_anomaly_flags_a_spike(spark):
    data = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(100 + i % 3)) for i in range(20)] + [(dt.date(2024, 1, 21), 500.0)]
    df = spark.createDataFrame(data, "day date, value double").withColumn("value", F.col("value").cast("decimal(20,2)"))
    got = {r.day: r for r in kpi_anomaly(df).collect()}
    values = [v for _, v in data]
    window = values[13:20]
    assert got[dt.date(2024, 1, 21)].z == pytest.approx((500 - np.mean(window)) / np.std(window, ddof=1), rel=1e-6)
    assert [d for d, r in got.items() if r.is_anomaly] == [dt.date(2024, 1, 21)]
    assert got[dt.date(2024, 1, 1)].z is None


def test_drift_with_itself_is_empty_and_hash_is_order_free(spark):
    df = spark.createDataFrame([("a", i, f"c{i}") for i in range(50)], "asset_type string, name int, content string")
    assert quality.drift_diff(df, df.orderBy(F.rand(1)), ["asset_type", "name"]).count() == 0
    cols = ["asset_type", "name", "content"]
    assert determinism_hash(df, cols).first() == determinism_hash(df.orderBy(F.rand(2)), cols).first()
    assert determinism_hash(df, cols).first() != determinism_hash(df.filter("name <> 7"), cols).first()


def test_shares_add_up(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    assert share_of_total(df, ["k"], F.sum("v")).agg(F.sum("share")).first()[0] == pytest.approx(1.0)


def test_coverage_counts_add_up(spark):
    for r in queries()["parity_coverage"](spark, SMALL).collect():
        assert r.total == r.gap_0 + r.gap_1 + r.gap_2 + r.gap_3


def test_load_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("CA", 1, 5), ("CA", 2, 6), (None, 2, 7), ("CA", 1, 5)], "state string, year int, num int")
    path = str(tmp_path / "t")
    rows.limit(0).write.parquet(path)
    assert warehouse.idempotent_load(spark, path, rows, ["state", "year"]) == 3
    assert warehouse.idempotent_load(spark, path, rows, ["state", "year"]) == 3


def test_corpus_files(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "node_modules").mkdir(parents=True)
    (root / "sub").mkdir()
    (root / "node_modules" / "skip.txt").write_text("redis://h/1")
    (root / "sub" / "a.env").write_text("X=redis://h/1\r\nDB_HOST=q\n")
    (root / "big.txt").write_text("x" * 2000)
    (root / "nul.bin").write_bytes(b"text\x00text")
    (root / "noise.bin").write_bytes(bytes(range(128, 256)) * 4)
    (root / "empty.txt").write_text("")
    (root / "latin.txt").write_bytes(b"plain text with one odd byte \xff here")
    kept = corpus.corpus_scan(corpus.read_files(spark, str(root)), max_bytes=1000)
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in kept.collect()}
    # the file source leaves out empty files, which hold nothing to find
    assert set(texts) == {"a.env", "latin.txt"} and "�" in texts["latin.txt"]
    numbered = corpus.lines(kept.filter(F.col("path").endswith("a.env"))).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in numbered] == [(1, "X=redis://h/1"), (2, "DB_HOST=q"), (3, "")]


def test_catalog_documents(spark, tmp_path):
    doc = {"version": "1", "catalogs": [{"site_id": "s", "root_url": "u", "nodes": [
        {"id": "a", "parent_id": None, "depth": 0, "title": "A", "tags": ["x"]},
        {"id": "b", "parent_id": "a", "depth": 1, "title": "B", "leaf_extractions": {"key_points": ["k"]}}]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    got = {r.id: r for r in catalog_json.read_catalog(spark, str(tmp_path / "c.json")).collect()}
    assert got["a"].leaf_extractions is None and got["b"].leaf_extractions.key_points == ["k"] and got["b"].parent_id == "a"
    parity = {"parity_map": [{"capability_id": "p", "domain": "Finance", "gap_level": 1, "enterprise_refs": ["a"], "parity_target": {
        "odoo_core": ["m"], "oca_modules": [{"repo": "r", "module": "x"}], "alt_stack": []}}], "coverage_summary": {"total_capabilities": 2}}
    (tmp_path / "p.json").write_text(json.dumps(parity))
    row = catalog_json.read_parity(spark, str(tmp_path / "p.json")).first()
    assert row.core_modules == ["m"] and row.community_modules[0].module == "x"
    assert catalog_json.read_stated_coverage(spark, str(tmp_path / "p.json")).first().total == 2
