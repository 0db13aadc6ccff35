"""Zero-inflated mixtures: derivatives against differences, known parameters from generated counts."""

import math

import numpy as np
import pytest

from raremetrics.models import gam, zip_mixture


def test_gamma_derivatives():
    for x in (0.05, 0.7, 1.0, 3.3, 8.0, 40.0):
        e = 1e-4 * x
        assert zip_mixture.digamma(np.array(x)) == pytest.approx((math.lgamma(x + e) - math.lgamma(x - e)) / (2 * e), rel=1e-5, abs=1e-7)
        assert zip_mixture.trigamma(np.array(x)) == pytest.approx((zip_mixture.digamma(np.array(x + e)) - zip_mixture.digamma(np.array(x - e))) / (2 * e), rel=1e-5)
    assert float(zip_mixture.digamma(np.array(1.0))) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert float(zip_mixture.trigamma(np.array(1.0))) == pytest.approx(math.pi**2 / 6, abs=1e-11)


@pytest.mark.parametrize("theta", [None, 0.4, 3.0])
def test_gradient_and_hessian_are_those_of_the_likelihood(theta):
    y, ez, ec = np.array([0.0, 0.0, 1.0, 2.0, 7.0]), np.array([-1.0, 0.5, 0.2, -0.3, 1.0]), np.array([0.3, -0.5, 0.1, 1.2, 0.7])
    t = math.log(theta) if theta else 0.0

    def at(a, b, c):
        return zip_mixture.mixture_part(y, ez + a, ec + b, math.exp(t + c) if theta else None)

    ll, grad, hess, _ = at(0, 0, 0)
    for i in range(3 if theta else 2):
        e = np.eye(3)[i] * 1e-5
        up, down = at(*e), at(*-e)
        assert grad[i] == pytest.approx((up[0] - down[0]) / 2e-5, rel=1e-5, abs=1e-8)
        for j in range(3 if theta else 2):
            assert hess[i, j] == pytest.approx((up[1][j] - down[1][j]) / 2e-5, rel=1e-4, abs=1e-7)
    # probabilities of all counts add to one
    k = np.arange(400.0)
    total = np.exp(zip_mixture.mixture_part(k, np.full(400, 0.4), np.full(400, 0.8), theta)[0]).sum()
    assert total == pytest.approx(1.0, abs=1e-6)


def generated(theta, n=12_000, seed=5):
    r = np.random.default_rng(seed)
    x, z, o = r.normal(size=n), r.normal(size=n), r.uniform(-0.3, 0.3, n)
    pi = 1 / (1 + np.exp(-(-0.5 + 0.8 * z)))
    lam = np.exp(0.6 + 0.5 * x + o)
    mean = lam if theta is None else r.gamma(theta, lam / theta)
    y = np.where(r.uniform(size=n) < pi, 0, r.poisson(mean))
    return [(float(a), float(b), float(c), float(d), "one" if i % 4 else "two") for i, (a, b, c, d) in enumerate(zip(x, z, o, y, strict=True))]


@pytest.mark.parametrize("theta", [None, 1.5])
def test_known_parameters_come_back(spark, theta):
    df = spark.createDataFrame(generated(theta), "x double, z double, o double, y double, g string")
    fits = zip_mixture.fit_zip(df, "y", [gam.Linear("x")], [gam.Linear("z")], group="g", offset="o", family="negbin" if theta else "poisson")
    for g, fit in fits.items():
        assert fit.converged
        table = fit.coefficients()
        truth = [-0.5, 0.8, 0.6, 0.5] + ([math.log(theta)] if theta else [])
        assert len(table) == len(truth) and (table.se > 0).all()
        assert (np.abs(table.estimate - truth) < 4 * table.se).all(), (g, table)
        assert (table.se < (0.1 if g == "one" else 0.2) * (3 if theta else 1)).all()
    if theta:  # the Poisson mixture explains these counts worse
        plain = zip_mixture.fit_zip(df, "y", [gam.Linear("x")], [gam.Linear("z")], group="g", offset="o")
        assert all(fits[g].loglik > plain[g].loglik + 20 for g in fits)


def test_unknown_family(spark):
    with pytest.raises(ValueError, match="gamma"):
        zip_mixture.fit_zip(spark.range(1), "id", [], [], family="gamma")


def test_gamma_functions_are_evaluated_on_distinct_counts_only(monkeypatch):
    import numpy as np
    from raremetrics.models import zip_mixture
    seen = []
    plain = zip_mixture.digamma
    monkeypatch.setattr(zip_mixture, "digamma", lambda x: seen.append(np.size(x)) or plain(x))
    y = np.tile([0.0, 1.0, 0.0, 3.0], 500)
    first = zip_mixture.count_part(y, np.full(2000, -1.0), 0.7)[2]
    assert max(seen) == 3
    each = plain(y + 0.7) - plain(np.array(0.7)) + np.log(0.7) + 1 - np.log(np.exp(-1) + 0.7) - (y + 0.7) / (np.exp(-1) + 0.7)
    assert np.allclose(first, 0.7 * each)
