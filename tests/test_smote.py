"""SMOTE: exact neighbours against brute force, sizes, and synthetic points on segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raremetrics.operators import neighbours, smote


def _fixture(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    # a dense cluster (a third of the minority) plus a sparse spread, one nominal column
    x = np.concatenate([rng.normal(0.5, 0.003, n // 3), rng.uniform(0, 1, n - n // 3)])
    y = np.concatenate([rng.normal(0.5, 0.003, n // 3), rng.uniform(0, 1, n - n // 3)])
    z = rng.uniform(0, 1, n)
    g = rng.choice(["a", "b"], n)
    cls = (np.arange(n) % 4 == 0).astype(int)          # minority = class 1
    rows = [(int(i), float(a), float(b), float(c), str(d), int(e)) for i, (a, b, c, d, e) in enumerate(zip(x, y, z, g, cls))]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, g string, cls int")


def test_knn_is_exact(spark):
    df = _fixture(spark).filter("cls = 1")
    nn = smote.knn_minority(df, "id", ["x", "y", "z"], ["g"], k=3).collect()
    pdf = df.toPandas()
    X = pdf[["x", "y", "z"]].to_numpy()
    G = pdf["g"].to_numpy()
    ids = pdf["id"].to_numpy()
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1) + (G[:, None] != G[None, :]))
    np.fill_diagonal(D, np.inf)
    got = {}
    for r in nn:
        got.setdefault(r.id, []).append(r.dist)
    assert len(got) == len(ids)
    for i, qid in enumerate(ids):
        assert np.allclose(sorted(got[qid]), np.sort(D[i])[:3], atol=1e-12)


def brute(rows, numeric, nominal, k):
    out = {}
    for a in rows:
        d = sorted((np.sqrt(sum((a[c] - b[c]) ** 2 for c in numeric) + sum(a[c] != b[c] for c in nominal)), b["id"]) for b in rows if b["id"] != a["id"])
        out[a["id"]] = d[:k]
    return out


def found(df, numeric, nominal, k):
    got = {}
    for r in neighbours.nearest(df, "id", numeric, nominal, k).collect():
        got.setdefault(r.id, []).append((r["rank"], r.dist, r.nb_id))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {i: [x[1:] for x in sorted(v)] for i, v in got.items()}


def same(got, want):
    assert got.keys() == {i for i, v in want.items() if v}
    for i, v in got.items():
        assert [n for _, n in v] == [n for _, n in want[i]], i
        assert np.allclose([d for d, _ in v], [d for d, _ in want[i]])


@pytest.mark.parametrize(("leaf", "leaves", "sample", "queries"), [(256, 4096, 65_536, 8192), (8, 4096, 65_536, 8192), (4, 64, 60, 3)])
def test_neighbours_equal_brute_force(spark, monkeypatch, leaf, leaves, sample, queries):
    """Ids and distances, with ties, copies of one place, many levels, single rows of a level and null levels."""
    for name, value in (("LEAF", leaf), ("LEAVES", leaves), ("SAMPLE", sample), ("QUERIES", queries)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(leaf)
    rows = [{"id": 900 - i, "x": float(r.integers(0, 6) / 5), "y": float(r.uniform()), "g": str(r.choice(list("aabc"))), "h": f"v{r.integers(0, 40)}"} for i in range(220)]
    rows += [{"id": 2000 + i, "x": 0.4, "y": 0.25, "g": "a", "h": "v1"} for i in range(110)]  # a third at one place
    rows += [{"id": 3000 + i, "x": 0.5, "y": 0.5, "g": None, "h": f"w{i}"} for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, y double, g string, h string")
    same(found(df, ["x", "y"], ["g", "h"], 5), brute(rows, ["x", "y"], ["g", "h"], 5))
    same(found(df, ["x", "y"], [], 2), brute(rows, ["x", "y"], [], 2))


def test_neighbours_of_few_rows(spark):
    rows = [{"id": i, "x": i / 4, "g": "a"} for i in range(3)]
    df = spark.createDataFrame(rows, "id long, x double, g string")
    same(found(df, ["x"], ["g"], 5), brute(rows, ["x"], ["g"], 5))
    same(found(df, [], ["g"], 5), brute(rows, [], ["g"], 5))
    assert neighbours.nearest(df.limit(1), "id", ["x"], ["g"]).count() == 0
    assert neighbours.nearest(df.limit(0), "id", ["x"], ["g"]).count() == 0


def test_smote_of_a_small_class_loses_no_synthetic_row(spark):
    df = spark.createDataFrame([(i, i / 7, "a", int(i < 3)) for i in range(40)], "id long, x double, g string, cls int")
    out = smote.smote(df, "cls", "id", ["x"], ["g"], 200, 100, k=5, seed=3)
    assert {(r.cls, r.synthetic): r["count"] for r in out.groupBy("cls", "synthetic").count().collect()} == {(1, False): 3, (1, True): 6, (0, False): 6}


def test_smote_sizes_and_segments(spark):
    df = _fixture(spark)
    out = smote.smote(df, "cls", "id", ["x", "y", "z"], ["g"], 100, 200, k=5, seed=7)
    c = {(r.cls, r.synthetic): r["count"] for r in out.groupBy("cls", "synthetic").count().collect()}
    m = df.filter("cls = 1").count()
    assert c[(1, False)] == m and c[(1, True)] == m and c[(0, False)] == 2 * m
    syn = out.filter("synthetic").select("x", "y", "z").collect()
    lo = df.filter("cls = 1").agg(*[F.min(v) for v in "xyz"], *[F.max(v) for v in "xyz"]).collect()[0]
    for r in syn:   # synthetic points stay inside the minority bounding box (convex combinations)
        for i, v in enumerate("xyz"):
            assert lo[i] - 1e-12 <= r[v] <= lo[3 + i] + 1e-12


def test_smote_reads_its_source_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    df = _fixture(spark, 120).mapInPandas(count, "id long, x double, y double, z double, g string, cls int")
    out = smote.smote(df, "cls", "id", ["x", "y", "z"], ["g"], 100, 200, k=3)
    assert out.filter("cls = 1").count() == 60
    assert read.value == 120
