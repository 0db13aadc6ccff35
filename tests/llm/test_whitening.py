"""Whitening by shifted CholeskyQR against an eigendecomposition of the covariance."""

import math

import numpy as np
import pytest

from raremetrics.llm import whitening


def table(spark, vectors, partitions=3):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(partitions)


def collected(df, n, k):
    out, dev = np.full((n, k), np.nan), {}
    rows = df.collect()
    for r in rows:
        out[r.vec_id, r.component - 1] = np.nan if r.whitened is None else r.whitened
        dev[r.vec_id] = r.deviation
    return out, dev, rows


def reference(vectors):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    a = (n * x - s) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    return a, e[::-1], v[:, ::-1], ((n * x - s) ** 2).sum(axis=1)


@pytest.mark.parametrize("spread", [np.ones(40), np.geomspace(1, 1e-3, 40) * 1e4])
def test_against_eigendecomposition(spark, spread):
    x = np.random.default_rng(3).normal(size=(300, 40)) * spread + 5
    x[:100] = x[0]  # a third of the rows is one vector
    got, dev, rows = collected(whitening.whitened(table(spark, x)), 300, 32)
    a, e, v, d = reference(x)
    want = (a @ v / np.sqrt(e))[:, :32]
    sign = np.sign((want * got).sum(axis=0))
    assert np.abs(want * sign - got).max() < 1e-6 * np.abs(want).max()
    assert [dev[i] for i in range(300)] == d.tolist()
    of = {r.component: r.explained for r in rows}
    assert np.allclose([of[i + 1] for i in range(32)], e[:32] / e.sum(), rtol=1e-9)
    assert {r.n for r in rows} == {300} and len(rows) == 300 * 32
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


def test_odd_vectors(spark):
    good = np.random.default_rng(4).normal(size=(30, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 0.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows = whitening.whitened(table(spark, good + bad)).collect()
    assert {r.vec_id for r in rows} == set(range(30)) and {r.component for r in rows} == {1, 2, 3} and len(rows) == 90
    assert rows[0].n == 30 and rows[0].identity_error < 1e-10


def test_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    x = np.random.default_rng(5).normal(size=(20, 4))
    t = table(spark, [*x, *x]).withColumn("vec_id", F.col("vec_id") % 20)
    extra = t.select("*", *[F.lit(f"own {c}").alias(c) for c in ("i", "values", "n", "size", "d", "s", "component", "label")])
    rows = whitening.whitened(extra).collect()
    assert len(rows) == 160 and {r.n for r in rows} == {40} and {r.label for r in rows} == {"own label"} and rows[0]["values"] == "own values"
    assert sorted({r.component for r in rows}) == [1, 2, 3, 4]


def test_lack_of_rank(spark):
    base = np.random.default_rng(6).normal(size=(50, 5))
    x = np.column_stack([np.floor(64 * base) / 64, np.floor(64 * base[:, 0]) / 64])  # the last column repeats the first
    got, _, rows = collected(whitening.whitened(table(spark, x)), 50, 6)
    assert np.isnan(got[:, 5]).all() and not np.isnan(got[:, :5]).any()
    assert rows[0].identity_error < 1e-9
    for few in ([x[0]], [x[0]] * 4):
        rows = whitening.whitened(table(spark, few)).collect()
        assert len(rows) == 6 * len(few) and all(r.whitened is None and r.explained is None and r.identity_error is None for r in rows)
        assert {r.deviation for r in rows} == {0}


def test_empty_and_large(spark):
    assert whitening.whitened(table(spark, [[1.0]]).limit(0)).count() == 0
    assert whitening.whitened(table(spark, [None, [math.nan]])).count() == 0
    rows = whitening.whitened(table(spark, [[2.0**44, 1.0], [-(2.0**44), 2.0], [0.0, 3.0]])).collect()
    assert {r.deviation for r in rows if r.vec_id == 0} == {None}  # beyond a long
    assert [r.whitened is None for r in rows] == [r.component == 2 for r in rows]  # 1e-14 of the first one's spread


def test_forward_substitution():
    r = np.triu(np.random.default_rng(7).normal(size=(6, 6))) + 5 * np.eye(6)
    a = np.random.default_rng(8).normal(size=(9, 6))
    assert np.allclose(whitening.solve(a, r) @ r, a)
