"""Stratified resampling inside the tasks: exact sizes, the right distribution, the same draws on every reading."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raremetrics.models import gam, partials, resample


def drawn(frame, d):
    def run(it):
        draws = d.task()
        for pdf in it:
            w = draws.weights(pdf)
            yield pd.DataFrame({"id": pdf["id"], "g": pdf["g"], "s": pdf["s"], "w": list(w)})

    return frame.mapInPandas(run, "id long, g string, s long, w array<double>").toPandas()


@pytest.fixture(scope="module")
def frame(spark):
    return (spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 7 % 4).alias("s"))
            .repartitionByRange(6, "id").checkpoint(eager=True))


def test_sizes_are_exact_and_readings_agree(spark, frame, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 64)
    d = resample.draws(frame, ["g", "s"], 20, 7)
    one = drawn(frame, d).sort_values("id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        two = drawn(frame, d).sort_values("id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    a, b = np.stack(one.w), np.stack(two.w)
    assert (a == b).all()  # whatever the batches
    for _, rows in one.groupby(["g", "s"]).indices.items():
        assert (a[rows].sum(axis=0) == len(rows)).all()
    assert not (a[:, 0] == a[:, 1]).all() and not (np.stack(drawn(frame, resample.draws(frame, ["g", "s"], 20, 8)).sort_values("id").w) == a).all()


def test_counts_are_those_of_a_bootstrap(frame):
    w = np.stack(drawn(frame, resample.draws(frame, ["g", "s"], 200, 3)).w)
    # mean 1, variance 1 - 1/n, share of rows not drawn near 1/e; a row's mean over replicates is near 1
    assert w.mean() == pytest.approx(1) and w.var() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert np.abs(w.mean(axis=1) - 1).max() < 0.4
    # shares of partitions vary like a multinomial's, too
    part = w.reshape(6, -1, 200).sum(axis=1) if len(w) % 6 == 0 else w[:2996].reshape(4, -1, 200).sum(axis=1)
    assert 0.7 < part.var(axis=1).mean() / (part.mean() * (1 - 1 / len(part))) < 1.3


def test_weighted_fits_equal_fits_of_the_drawn_rows(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(600), "g": "a", "s": np.arange(600) % 3, "x": r.normal(size=600)})
    pdf["y"] = (r.uniform(size=600) < 1 / (1 + np.exp(-pdf.x))).astype(float)
    from raremetrics.session import spread
    frame = spread(spark.createDataFrame(pdf))
    d = resample.draws(frame, ["g", "s"], 3, 5)
    fits = gam.fit_gam(frame, "y", [gam.Linear("x")], family="binomial", link="logit", group="g", exact_boot=d)
    w = drawn(frame, d).set_index("id").w
    assert [f.group for f in fits] == [("a", b) for b in range(3)]
    for f in fits:
        copies = pdf.loc[np.repeat(pdf.index, [int(w[i][f.group[1]]) for i in pdf.id])]
        plain = gam.fit_gam(spark.createDataFrame(copies), "y", [gam.Linear("x")], family="binomial", link="logit")[0]
        assert f.converged and f.beta == pytest.approx(plain.beta, abs=1e-6) and f.n == 600


def test_empty_frame(spark, frame):
    d = resample.draws(frame.limit(0).checkpoint(), ["g", "s"], 2)
    assert d.upto == {}
