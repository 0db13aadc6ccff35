"""The passes over model frames: sums by factor level against dense products, sources read once, rows not copied."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raremetrics.models import bootstrap, families, gam, glm, zeroinfl


def design():
    terms = [gam.Linear("x"), gam.Factor("f", ["a", "b", "c"]), gam.Linear("z"), gam.Factor("h", ["1", "2"])]
    d = gam.Design(terms, ["(Intercept)", "x", "fb", "fc", "z", "h2"])
    d.blocks = {"(Intercept)": slice(0, 1), "x": slice(1, 2), "f": slice(2, 4), "z": slice(4, 5), "h": slice(5, 6)}
    return d


def frame(n=500):
    r = np.random.default_rng(3)
    return pd.DataFrame({"id": np.arange(n), "x": r.normal(size=n), "z": r.normal(size=n), "f": r.choice(["a", "b", "c", "unknown"], n),
                         "h": r.integers(1, 3, n), "g": r.choice(["s", "t"], n), "y": r.integers(0, 2, n).astype(float)})


def test_factor_columns_are_those_of_each_level():
    pdf, d = frame(), design()
    X = d.matrix(pdf)
    assert (X[:, 2] == (pdf.f == "b")).all() and (X[:, 3] == (pdf.f == "c")).all() and (X[:, 5] == (pdf.h == 2)).all()
    D, codes = d.split(pdf)
    plain, factors = d.places()
    assert (X[:, plain] == D).all() and [f.tolist() for f in factors] == [[-1, 2, 3], [-1, 5]]


@pytest.mark.parametrize("replicates", [None, 4])
def test_a_pass_equals_dense_products(replicates):
    pdf, d, fam = frame(), design(), families.family("binomial", "cloglog")
    groups = [(g, b) for g in "st" for b in range(replicates)] if replicates else ["s", "t"]
    betas = [np.random.default_rng(i).normal(size=6) / 4 for i in range(len(groups))]
    fn, size = gam._partials_fn(d, fam, betas, "y", None, None, "g", groups, None, ("id", replicates, 5) if replicates else None)
    got = next(fn(iter([pdf[:300], pdf[300:]])))
    X, weights = d.matrix(pdf), gam.poisson_weights(pdf["id"].to_numpy(), replicates or 1, 5)
    for key, raw in zip(got["key"], got["values"]):
        g, b = groups[key] if replicates else (groups[key], None)
        m = (pdf.g == g).to_numpy()
        w, y, eta = (weights[m, b] if replicates else np.ones(m.sum())), pdf.y.to_numpy()[m], X[m] @ betas[key]
        mu, me = fam.linkinv(eta), fam.mu_eta(eta)
        W = w * me * me / fam.variance(mu)
        out = np.frombuffer(raw)
        assert out[:36].reshape(6, 6) == pytest.approx((X[m] * W[:, None]).T @ X[m])
        assert out[36:42] == pytest.approx(X[m].T @ (W * (eta + (y - mu) / me)))
        assert out[-2] == pytest.approx(fam.deviance(y, mu, w)) and out[-1] == w.sum()
    assert len(got) == len(groups)


def test_sequential_anova_reads_its_source_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    df = spark.createDataFrame(frame(200)).mapInPandas(count, "id long, x double, z double, f string, h long, g string, y double")
    assert len(glm.sequential_anova(df, "y", [("f", "factor"), ("x", "numeric")])) == 3
    assert read.value == 200


def test_replicates_do_not_copy_rows(spark, monkeypatch):
    pdf = frame(400).assign(yr=lambda p: p["id"] % 3, n=lambda p: p["y"].astype(int))
    df = spark.createDataFrame(pdf)
    full = zeroinfl.fit_hurdle_poisson(df, "n", [gam.Linear("x")], group="g")
    seen, plain = [], gam.fit_gam

    def counted(rows, *a, **k):
        seen.append(rows.count())
        return plain(rows, *a, **k)

    monkeypatch.setattr(gam, "fit_gam", counted)
    fits, loglam = bootstrap.refit_replicates(df, full, "n", "n", "g", "id", df, ["yr"], 6)
    assert sorted(fits) == sorted(loglam) == [(g, b) for g in "st" for b in range(1, 7)]
    assert seen[0] <= 400 and all(abs(sum(fits[g, b].n for g in "st") - 400) < 1e-9 for b in range(1, 7))
