"""Whitening against a plain eigendecomposition, and its defined results at the edges."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm.queries import op11_embedding_whitening
from tallymark.llm.whitening import FAN_IN, deviations, eigen, pivoted_cholesky, rotated, whiten

FOLDER = "/root/testdata/sf0.001"


def plain(rows, k=4):
    """{id: [(deviation, whitened, explained)]} by numpy's own eigendecomposition, and n."""
    kept = [(i, [math.floor(float(np.float32(c)) * 256) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    mean = fit.mean(0)
    covariance = (fit - mean).T @ (fit - mean) / len(fit)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    sums = fit.astype(int).sum(0).tolist()
    return len(fit), [(i, sum((len(fit) * v - s) ** 2 for v, s in zip(x, sums)),
                       (np.array(x) - mean) @ vectors / np.sqrt(values), values / covariance.trace()) for i, x in kept]


def check(got, rows, k=4):
    n, expected = plain(rows, k)
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-9
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == k * len(expected) and set(by) == {i for i, *_ in expected}
    signs = np.sign([[by[i][c + 1].whitened * w[c] for c in range(k)] for i, _, w, _ in expected if np.abs(w).min() > 1e-3])
    assert (signs == signs[0]).all()  # one sign per component, the same in all rows
    for i, far, w, share in expected:
        assert [by[i][c + 1].deviation for c in range(k)] == [far] * k
        assert np.allclose([by[i][c + 1].whitened for c in range(k)], w * signs[0], rtol=1e-8, atol=1e-9)
        assert np.allclose([by[i][c + 1].explained for c in range(k)], share, rtol=1e-9)


def test_query_equals_a_plain_eigendecomposition(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(op11_embedding_whitening(spark, FOLDER).collect(), rows)


def test_repeated_and_broken_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.normal(size=6) * [9, 5, 3, 1, .5, .2]).astype(np.float32).tolist()) for i in range(80)]
    rows = good + [(100 + i, good[i % 3][1]) for i in range(60)]  # copies of three vectors are fitted once each
    broken = [(200, None), (201, [None] + [1.0] * 5), (202, [float("nan")] * 6), (203, [1.0] * 5 + [float("-inf")]),
              (204, []), (205, [1.0, 2.0])]
    table = spark.createDataFrame(rows + broken, "vec_id long, embedding array<float>").withColumns(
        {"x": F.lit("mine"), "id": F.lit(1), "n": F.lit(0), "component": F.lit(None)})
    check(whiten(table).collect(), rows)


def test_more_parts_than_one_merge_takes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(500)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(FAN_IN + 9))
    try:
        check(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
                    "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(key)


def test_nothing_varies(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whiten(spark.createDataFrame(rows, schema)).collect() == []


def test_fewer_components_than_asked_for(spark):
    rows = [(None, [1.0, 2.0, 7.0]), (4, [2.0, 4.0, 7.0]), (4, [2.0, 4.0, 7.0]), (5, [3.5, 7.0, 7.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.component for r in got] == [1] * 4 and {r.n for r in got} == {3}
    assert all(abs(r.explained - 1) < 1e-12 for r in got) and sum(r.vec_id is None for r in got) == 1
    assert len({r.whitened for r in got if r.vec_id == 4}) == 1


def test_very_large_entries(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    x = [[2**63 - 1, 256], [-2**63, 256], [256, 512]]  # what lies beyond 64 bits counts as the largest number
    far = sum((3 * v - sum(c)) ** 2 for v, c in zip(x[2], zip(*x)))
    assert {(r.vec_id, r.deviation) for r in got} == {(1, None), (2, None), (3, far)}


def test_exact_deviations_in_both_widths():
    rng = np.random.default_rng(3)
    for size, n in ((10**3, 50), (10**9, 10**6), (2**62, 7)):
        x = rng.integers(-size, size, (20, 3))
        sums = tuple(int(v) for v in rng.integers(-size, size, 3))
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        assert deviations(x, n, sums) == [v if v < 2**63 else None for v in exact]


@pytest.mark.parametrize("d", [1, 2, 5, 64, 129])
def test_factor_and_rotations(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d)) * np.logspace(0, 5, d)
    a = a @ a.T
    factor = pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a, rtol=1e-12, atol=1e-12 * a.max())
    pivots = np.argsort((factor != 0).sum(axis=1))
    assert np.allclose(np.triu(factor[pivots], 1), 0)  # triangular in the order of the pivots
    turned = rotated(factor)
    values, vectors = eigen(a)
    assert np.allclose(turned @ turned.T, a, rtol=1e-10, atol=1e-10 * a.max())
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-9, atol=1e-12 * a.max())
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_rank_of_the_factor():
    rng = np.random.default_rng(9)
    b = rng.normal(size=(30, 4))
    assert pivoted_cholesky(b @ b.T).shape == (30, 4)
    assert pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
    values, vectors = eigen(np.diag([2.0, 2.0, 0.0, 5.0]))
    assert np.allclose(values, [5, 2, 2]) and vectors.shape == (4, 3)
