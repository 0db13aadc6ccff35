"""Model engine: numeric parity with MLlib and numpy, spline properties, hurdle intercept."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from raremetrics.models import gam, zeroinfl
from raremetrics.models.splines import CubicBasis, sum_to_zero


def _frame(spark, n=2000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 6, n)
    m = rng.integers(1, 13, n)
    f = rng.choice(["a", "b", "c"], n)
    eta = -2.0 + 0.3 * x + np.sin(2 * np.pi * m / 12) + (f == "b") * 0.5
    y = rng.poisson(np.exp(eta))
    rows = [(int(i), float(a), int(b), str(c), int(d)) for i, (a, b, c, d) in enumerate(zip(x, m, f, y))]
    return spark.createDataFrame(rows, "id long, x double, m int, f string, y long")


def test_unpenalised_glm_matches_mllib(spark):
    df = _frame(spark).withColumn("p", (F.col("y") > 0).cast("double"))
    fit = gam.fit_gam(df, "p", [gam.Linear("x")], family="binomial", link="cloglog", select_lambda=False)[0]
    va = VectorAssembler(inputCols=["x"], outputCol="v")
    ml = GeneralizedLinearRegression(family="binomial", link="cloglog", featuresCol="v", labelCol="p").fit(
        va.transform(df))
    assert abs(fit.beta[0] - ml.intercept) < 1e-6
    assert abs(fit.beta[1] - ml.coefficients[0]) < 1e-6
    assert abs(fit.deviance - ml.summary.deviance) < 1e-6


def test_grouped_fit_equals_separate_fits(spark):
    df = _frame(spark)
    both = df.withColumn("g", F.lit("one")).unionByName(df.withColumn("g", F.lit("two")))
    terms = [gam.Linear("x"), gam.Factor("f", ["a", "b", "c"])]
    fits = gam.fit_gam(both, "y", terms, family="poisson", group="g")
    single = gam.fit_gam(df, "y", [gam.Linear("x"), gam.Factor("f", ["a", "b", "c"])], family="poisson")[0]
    for f in fits:
        assert np.allclose(f.beta, single.beta, atol=1e-8)


def test_gam_recovers_cyclic_month_effect(spark):
    df = _frame(spark, n=4000)
    fit = gam.fit_gam(df, "y", [gam.Smooth("m", 12, cyclic=True), gam.Linear("x")], family="poisson")[0]
    assert fit.converged
    tt = fit.term_table().set_index("term")
    assert tt.loc["s(m)", "p_value"] < 0.01 and tt.loc["s(m)", "edf"] > 1.0
    assert abs(fit.beta[fit.design.names.index("x")] - 0.3) < 0.1


def test_spline_interpolates_and_is_cyclic():
    kn = np.array([0.0, 1.0, 2.5, 4.0, 6.0])
    b = CubicBasis(kn)
    beta = np.sin(kn)
    assert np.allclose(b.evaluate(kn) @ beta, beta)
    assert np.allclose(b.evaluate(np.linspace(0, 6, 50)).sum(axis=1), 1.0)
    c = CubicBasis(np.arange(1.0, 13.0), cyclic=True)
    v = c.evaluate(np.array([1.0, 12.0]))
    assert np.allclose(v[0], v[1])


def test_sum_to_zero_constraint():
    c = np.array([3.0, 1.0, 2.0, 5.0])
    Z = sum_to_zero(c)
    assert Z.shape == (4, 3) and np.allclose(c @ Z, 0.0)


def test_truncated_poisson_root():
    lam = zeroinfl.solve_truncated_poisson(1.6)
    assert abs(lam / (1 - math.exp(-lam)) - 1.6) < 1e-10
    assert zeroinfl.solve_truncated_poisson(1.0) < 1e-6


def test_firth_is_finite_under_separation_and_solves_the_adjusted_score(spark):
    x = np.linspace(-3, 3, 60)
    y = (x > 0).astype(float)                       # complete separation: ML diverges
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = gam.fit_gam(df, "y", [gam.Linear("x")], family="binomial", link="logit", firth=True, max_iter=200)[0]
    assert fit.converged and np.all(np.isfinite(fit.beta)) and abs(fit.beta[1]) < 10
    X = np.column_stack([np.ones_like(x), x])
    mu = 1 / (1 + np.exp(-(X @ fit.beta)))
    W = mu * (1 - mu)
    H = X.T @ (X * W[:, None])
    h = W * np.einsum("ij,jk,ik->i", X, np.linalg.inv(H), X)
    score = X.T @ (y - mu + h * (0.5 - mu))
    assert np.max(np.abs(score)) < 1e-6


def test_random_intercept_reml_matches_dense_solution(spark):
    from raremetrics.models import mixed
    rng = np.random.default_rng(5)
    G, m = 12, 25
    g = np.repeat(np.arange(G), m)
    x = rng.normal(size=G * m)
    u = rng.normal(0, 0.8, G)
    y = 1.0 + 0.5 * x + u[g] + rng.normal(0, 1.0, G * m)
    df = spark.createDataFrame([(f"v{a}", float(b), float(c)) for a, b, c in zip(g, x, y)], "v string, x double, y double")
    fit = mixed.fit_random_intercept(df, "y", [gam.Linear("x")], "v")
    # dense REML at the fitted variance ratio: beta = (X'V^-1X)^-1 X'V^-1 y
    X = np.column_stack([np.ones_like(x), x])
    V = np.eye(len(y)) + fit.gamma * (g[:, None] == g[None, :])
    Vi = np.linalg.inv(V)
    beta = np.linalg.solve(X.T @ Vi @ X, X.T @ Vi @ y)
    assert np.allclose(fit.beta, beta, atol=1e-8)
    assert 0.2 < fit.sigma2_group < 2.0 and 0.6 < fit.sigma2 < 1.5

    def reml(lg):
        Vg = np.eye(len(y)) + math.exp(lg) * (g[:, None] == g[None, :])
        Vgi = np.linalg.inv(Vg)
        A = X.T @ Vgi @ X
        b = np.linalg.solve(A, X.T @ Vgi @ y)
        r = (y - X @ b) @ Vgi @ (y - X @ b)
        s2 = r / (len(y) - 2)
        return -0.5 * ((len(y) - 2) * math.log(s2) + np.linalg.slogdet(Vg)[1] + np.linalg.slogdet(A)[1])
    lg = math.log(fit.gamma)
    assert reml(lg) >= reml(lg + 0.05) - 1e-9 and reml(lg) >= reml(lg - 0.05) - 1e-9


def test_zip_mixture_recovers_parameters_and_solves_score(spark):
    from raremetrics.models import zip_mixture
    rng = np.random.default_rng(11)
    n = 4000
    x = rng.uniform(0, 2, n)
    pi = 1 / (1 + np.exp(-(-0.5 + 1.0 * (x > 1))))
    lam = np.exp(0.3 + 0.6 * x)
    y = np.where(rng.uniform(size=n) < pi, 0, rng.poisson(lam))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, (x > 1).astype(float), y)],
                               "x double, hi double, y long")
    fit = zip_mixture.fit_zip(df, "y", [gam.Linear("x")], [gam.Linear("hi")])[0]
    assert fit.converged
    assert abs(fit.beta[1] - 0.6) < 0.15 and abs(fit.gamma[1] - 1.0) < 0.4
    # score is ~0 at the optimum (numpy recomputation)
    Z = np.column_stack([np.ones(n), (x > 1).astype(float)])
    X = np.column_stack([np.ones(n), x])
    p_ = 1 / (1 + np.exp(-(Z @ fit.gamma)))
    l_ = np.exp(X @ fit.beta)
    e = np.exp(-l_)
    p0 = p_ + (1 - p_) * e
    dz = np.where(y == 0, p_ * (1 - p_) * (1 - e) / p0, -p_)
    dc = np.where(y == 0, -(1 - p_) * l_ * e / p0, y - l_)
    assert np.max(np.abs(np.concatenate([Z.T @ dz, X.T @ dc]))) < 1e-4


def test_poisson_bootstrap_replicates_center_on_full_fit(spark):
    df = _frame(spark, n=3000, seed=4)
    terms = [gam.Linear("x")]
    full = gam.fit_gam(df, "y", terms, family="poisson")[0]
    reps = gam.fit_gam(df, "y", terms, family="poisson", design=full.design, poisson_boot=("id", 30, 9),
                       start={(0, b): full.beta for b in range(30)})
    assert len(reps) == 30 and all(r.converged for r in reps)
    slopes = np.array([r.beta[1] for r in reps])
    se = math.sqrt(full.Vp[1, 1])
    assert abs(slopes.mean() - full.beta[1]) < 3 * se / math.sqrt(30) + 1e-3
    assert 0.5 * se < slopes.std(ddof=1) < 2.0 * se


def test_lda_matches_numpy(spark):
    from raremetrics.models import discriminant
    rng = np.random.default_rng(8)
    n = 600
    y = (rng.uniform(size=n) < 0.3).astype(int)
    X = rng.normal(size=(n, 3)) + y[:, None] * np.array([1.0, -0.5, 0.2])
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, X)], "y int, a double, b double, c double")
    fit = discriminant.fit_lda(df, "y", ["a", "b", "c"])
    m1, m0 = X[y == 1].mean(0), X[y == 0].mean(0)
    S = ((X[y == 1] - m1).T @ (X[y == 1] - m1) + (X[y == 0] - m0).T @ (X[y == 0] - m0)) / (n - 2)
    assert np.allclose(fit.coef, np.linalg.solve(S, m1 - m0), atol=1e-9)


def test_emmeans_average_design_rows(spark):
    from pyspark.sql import functions as F
    from raremetrics.models import effects
    df = _frame(spark, n=1500).withColumn("p", (F.col("y") > 0).cast("double"))
    fit = gam.fit_gam(df, "p", [gam.Factor("f"), gam.Linear("x")], family="binomial", link="logit")[0]
    ref = df.agg(F.avg("x").alias("x"))
    out = {r.f: r for r in effects.emmeans(fit, ref, "f", ["f"], "logit").collect()}
    xbar = ref.collect()[0][0]
    for lv in ["a", "b", "c"]:
        row = np.array([1.0, float(lv == "b"), float(lv == "c"), xbar])
        assert abs(out[lv].emmean - row @ fit.beta) < 1e-9
        assert abs(out[lv].se - math.sqrt(row @ fit.Vp @ row)) < 1e-9


def test_negbin_theta_by_maximum_likelihood(spark):
    from raremetrics.models import zeroinfl
    rng = np.random.default_rng(21)
    n = 4000
    x = rng.uniform(0, 2, n)
    mu = np.exp(0.5 + 0.4 * x)
    theta = 2.0
    y = rng.poisson(rng.gamma(theta, mu / theta))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y long")
    res = zeroinfl.fit_negbin_gam(df, "y", [gam.Linear("x")], rounds=2)
    f, th = res[0]
    assert 1.4 < th < 2.9
    assert abs(f.beta[1] - 0.4) < 0.1


def test_chi_square_tail_matches_table_values():
    from raremetrics.functions.distributions import chi2_sf_scalar, norm_sf_scalar
    # textbook 5 % and 1 % critical values
    for stat, dof, p in [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05),
                         (6.634897, 1, 0.01), (124.342113, 100, 0.05)]:
        assert abs(chi2_sf_scalar(stat, dof) - p) < 1e-6
    assert abs(norm_sf_scalar(1.959964) - 0.025) < 1e-6


def test_thin_plate_of_full_rank_is_the_natural_smoothing_spline():
    """With as many coefficients as knots the penalised fit equals that of the natural cubic basis."""
    from raremetrics.models.splines import ThinPlateBasis

    r = np.random.default_rng(4)
    knots = np.sort(r.uniform(110, 122, 12))
    x = r.uniform(knots[0], knots[-1], 200)
    y = np.sin(x) + 0.1 * r.normal(size=200)
    natural, plate = CubicBasis(knots), ThinPlateBasis(knots, 12)
    new = np.linspace(knots[0] - 2, knots[-1] + 2, 90)  # linear beyond the knots
    fits = []
    for basis, lam in ((natural, 0.3), (plate, 0.3 / np.ptp(knots) ** 3)):
        X = basis.evaluate(x)
        fits.append(basis.evaluate(new) @ np.linalg.solve(X.T @ X + lam * basis.S, X.T @ y))
    assert np.allclose(fits[0], fits[1], atol=1e-6)


def test_thin_plate_of_low_rank(spark):
    from raremetrics.models.splines import ThinPlateBasis

    r = np.random.default_rng(5)
    knots = np.linspace(0, 1, 60)
    basis = ThinPlateBasis(knots, 10)
    e = np.linalg.eigvalsh(basis.S)
    assert basis.n_coef == 10 and e.min() > -1e-10 and (e > 1e-10).sum() == 8
    # the penalty is the integral of the squared second derivative, by differences
    b = r.normal(size=10)
    grid = np.linspace(0, 1, 20_001)
    f = basis.evaluate(grid) @ b
    bend = np.diff(f, 2) / (grid[1] - grid[0]) ** 2
    assert b @ basis.S @ b == pytest.approx((bend**2).sum() * (grid[1] - grid[0]), rel=1e-2)
    # its best fit of a smooth curve is close
    y = np.exp(np.sin(5 * grid[::50]))
    X = basis.evaluate(grid[::50])
    assert np.abs(X @ np.linalg.lstsq(X, y, rcond=None)[0] - y).max() < 0.03
    x = r.uniform(0, 10, 800)
    y = r.poisson(np.exp(0.5 + np.sin(x)))
    df = spark.createDataFrame([(float(a), int(c)) for a, c in zip(x, y, strict=True)], "x double, y int")
    fits = {k: gam.fit_gam(df, "y", [gam.Smooth("x", 12, basis=k)], family="poisson")[0] for k in ("tp", "cr")}
    at = pd.DataFrame({"x": np.linspace(0.5, 9.5, 40)})
    curves = {k: f.eta_se(at)[0] for k, f in fits.items()}
    assert all(f.converged for f in fits.values())
    assert np.abs(curves["tp"] - (0.5 + np.sin(at.x))).max() < 0.35 and np.abs(curves["tp"] - curves["cr"]).max() < 0.25


def test_firth_with_offset_and_a_separated_level(spark):
    """Coefficients stay finite and solve Firth's score equations, also from a start far from them."""
    r = np.random.default_rng(9)
    n = 400
    x, o, f = r.normal(size=n), r.uniform(1, 7, n), r.choice(list("abc"), n)
    y = (r.uniform(size=n) < 1 / (1 + np.exp(-(-6 + 0.7 * x + o)))).astype(int)
    y[f == "c"] = 0  # a level without any presence
    df = spark.createDataFrame([(float(a), float(b), str(c), float(d)) for a, b, c, d in zip(x, o, f, y, strict=True)], "x double, o double, f string, y double")
    X = np.column_stack([np.ones(n), x, f == "b", f == "c"]).astype(float)
    for start in (None, {0: [-6.0, 0, 0, 0]}):
        fit = gam.fit_gam(df, "y", [gam.Linear("x"), gam.Factor("f")], family="binomial", link="logit", offset="o", firth=True,
                          factor_ridge=0.0, start=start, tol=1e-12)[0]
        mu = 1 / (1 + np.exp(-(X @ fit.beta + o)))
        w = mu * (1 - mu)
        hat = w * np.einsum("ij,jk,ik->i", X, np.linalg.inv(X.T @ (X * w[:, None])), X)
        assert fit.converged and np.abs(X.T @ (y - mu + hat * (0.5 - mu))).max() < 1e-4
        assert -12 < fit.beta[3] < -2


def test_smooth_terms_of_noise_have_uniform_p_values(spark):
    """A smooth of a variable that the counts do not depend on, in 100 fits; and one that they follow."""
    rng = np.random.default_rng(5)
    n, fits = 150, 100
    x = rng.uniform(size=n * fits)
    pdf = pd.DataFrame({"g": np.repeat(np.arange(fits), n), "x": x, "y": rng.poisson(3.0, n * fits).astype(float)})
    pdf["z"] = rng.poisson(np.exp(1 + np.sin(6 * x))).astype(float)
    frame = spark.createDataFrame(pdf)

    def p_values(column, rows):
        found = gam.fit_gam(rows, column, [gam.Smooth("x", 8)], group="g")
        return np.sort([f.term_table().p_value.iloc[0] for f in found])

    p = p_values("y", frame)
    at = np.arange(1, fits + 1) / fits
    assert np.maximum(at - p, p - at + 1 / fits).max() < 1.63 / np.sqrt(fits)  # Kolmogorov-Smirnov, 1 %
    assert p_values("z", frame.filter("g < 5")).max() < 1e-6


def test_grouped_anova_equals_mllib_per_group(spark):
    from raremetrics.models import glm

    df = _frame(spark, n=3000).withColumns({"p": (F.col("y") > 1).cast("double"), "off": F.col("x") / 10,
                                            "g": F.when(F.col("id") % 3 == 0, "one").otherwise("two")}).cache()
    got = glm.grouped_anova(df, "p", [gam.Factor("f"), gam.Linear("x")], "g", offset="off")
    assert got.converged.all() and got.groupby("g").size().to_dict() == {"one": 3, "two": 3}
    for g in ("one", "two"):
        want = glm.sequential_anova(df.filter(F.col("g") == g), "p", [("f", "factor"), ("x", "numeric")], offset="off")
        own = got[got.g == g].reset_index(drop=True)
        assert own.term.tolist() == want.term.tolist() and own.df.tolist() == want.df.tolist()
        assert own.resid_df.tolist() == want.resid_df.tolist()
        for c in ("deviance", "resid_dev", "pct_null_deviance"):
            np.testing.assert_allclose(own[c], want[c], rtol=1e-4, atol=1e-4)
        np.testing.assert_allclose(own.p_value[:2], want.p_value[:2], rtol=1e-3, atol=1e-12)


def test_grouped_anova_uses_one_set_of_rows(spark):
    """Rows that lack a later term are left out of the earlier prefixes too; a group of one level gets 0 df."""
    from raremetrics.models import glm

    df = _frame(spark, n=900).withColumns({"p": (F.col("y") > 1).cast("double"), "g": F.lit("only"), "one": F.lit("same"),
                                           "x": F.when(F.col("id") % 4 > 0, F.col("x"))})
    got = glm.grouped_anova(df, "p", [gam.Factor("one"), gam.Linear("x")], "g")
    assert got.df.tolist() == [0, 1, 1] and got.resid_df.tolist() == [674, 673, 673]
    assert abs(got.deviance[0]) < 1e-9 and math.isnan(got.p_value[0])


def test_rbf_svm_reads_its_source_once(spark, monkeypatch):
    from raremetrics.plans import catalog

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = [(i, int(i % 3 == 0), i % 7 + 0.5, 114 + i % 5 * 0.3, -18 + i % 4 * 0.2, i % 12 + 1) for i in range(150)]
    kind = "shot_id long, narrow long, hrs double, lon double, lat double, mn int"
    df = spark.createDataFrame(rows, kind).mapInPandas(count, kind)
    monkeypatch.setattr(catalog, "_model_frame", lambda spark, d: df)
    (row,) = catalog.QUERIES["rbf_svm"](spark, "").collect()
    assert (row.n_pos, row.n_neg) == (15, 30) and 0 <= row.auc <= 1
    assert read.value == 150


def test_model_comparison_reads_its_source_once_and_fits_like_single_learners(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    from raremetrics.models import classify, evaluate
    from raremetrics.plans import catalog

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = [(i, int(i % 3 == 0), i % 7 + 0.5, 114 + i % 5 * 0.3, -18 + i % 4 * 0.2, i % 12 + 1, "SprSu" if i % 12 < 6 else "AutWin",
             ("Long", "Short", "Standard")[i % 3 if i % 5 else 0]) for i in range(150)]
    kind = "shot_id long, narrow long, hrs double, lon double, lat double, mn int, season string, effort_class string"
    df = spark.createDataFrame(rows, kind).mapInPandas(count, kind)
    few = {"glm": LogisticRegression(maxIter=5), "gbm": GBTClassifier(maxIter=2, maxDepth=2, seed=1)}
    monkeypatch.setattr(catalog, "_model_frame", lambda spark, d: df)
    monkeypatch.setattr(catalog.derive, "with_classes", lambda m, hour=None: m)
    monkeypatch.setattr(classify, "learners", lambda: few)
    got = {r.model: r for r in catalog.QUERIES["model_comparison"](spark, "").collect()}
    assert read.value == 150
    m = catalog._classification_frame(spark, "").checkpoint(eager=True)
    for name, learner in few.items():
        p = classify.positive_score(learner.fit(m.filter("split = 'train'")).transform(m.filter("split = 'test'")))
        (one,) = evaluate.auc(p, "label", "score").collect()
        assert (got[name].n_pos, got[name].n_neg) == (one.n_pos, one.n_neg) == (15, 30)
        assert got[name].auc == pytest.approx(one.auc, abs=1e-6)


def test_model_comparison_has_all_learners_and_the_confusion_of_their_classes(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC, LogisticRegression

    from raremetrics.models import classify, discriminant
    from raremetrics.plans import catalog

    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        x = rng.normal()
        rows.append((i, int(abs(x) + 0.2 * rng.normal() > 0.7), x, 114 + rng.uniform(), -18 + rng.uniform(), i % 12 + 1,
                     "SprSu" if i % 12 < 6 else "AutWin", ("Long", "Short", "Standard")[i % 3]))
    df = spark.createDataFrame(rows, "shot_id long, narrow long, hrs double, lon double, lat double, mn int, season string, effort_class string")
    few = {"glm": LogisticRegression(maxIter=5), "svm": LinearSVC(maxIter=5)}
    monkeypatch.setattr(catalog, "_model_frame", lambda spark, d: df)
    monkeypatch.setattr(catalog.derive, "with_classes", lambda m, hour=None: m)
    monkeypatch.setattr(classify, "learners", lambda: few)
    got = {r.model: r for r in catalog.QUERIES["model_comparison"](spark, "").collect()}
    assert set(got) == {"glm", "svm", "lda", "svm_radial"}
    m = catalog._classification_frame(spark, "").checkpoint(eager=True)
    train, test = m.filter("split = 'train'"), m.filter("split = 'test'")
    frames = {name: learner.fit(train).transform(test) for name, learner in few.items()}
    frames |= discriminant.discriminant_scores(train, test, "label", "features")
    for name, frame in frames.items():
        pairs = [(r.label, r.prediction) for r in frame.select("label", "prediction").collect()]
        r = got[name]
        assert (r.tp, r.fp, r.tn, r.fn) == tuple(pairs.count(p) for p in ((1, 1), (0, 1), (0, 0), (1, 0)))
        assert r.sensitivity == pytest.approx(r.tp / r.n_pos, abs=1e-6) and r.specificity == pytest.approx(r.tn / r.n_neg, abs=1e-6)
        assert r.accuracy == pytest.approx((r.tp + r.tn) / len(pairs), abs=1e-6)
    # presence depends on |hrs|: no plane parts the classes, a radial kernel does
    assert got["svm_radial"].auc > 0.8 > 0.7 > max(got[n].auc for n in ("glm", "svm", "lda"))
    # the discriminant is that of the pooled covariance, on any scale of the inputs
    x = {s: np.array([(*r.features.toArray(), r.label) for r in part.collect()]) for s, part in (("train", train), ("test", test))}
    a, y = x["train"][:, :-1], x["train"][:, -1]
    one, none = a[y == 1], a[y == 0]
    pooled = ((one - one.mean(0)).T @ (one - one.mean(0)) + (none - none.mean(0)).T @ (none - none.mean(0))) / (len(a) - 2)
    w = np.linalg.pinv(pooled) @ (one.mean(0) - none.mean(0))
    cut = w @ (one.mean(0) + none.mean(0)) / 2 - np.log(len(one) / len(none))
    want = sorted(x["test"][:, :-1] @ w - cut)
    assert sorted(r.score for r in frames["lda"].collect()) == pytest.approx(want, abs=1e-6)


def test_cuts_below_counts_like_a_scan_of_all_cuts(spark):
    from raremetrics.models import evaluate

    rng = np.random.default_rng(3)
    cuts = np.sort(rng.integers(0, 400, 1023)).astype(float).tolist()
    scores = [-1.0, 0.0, 399.0, 400.0, float("nan"), *rng.uniform(-5, 405, 300).tolist(), *cuts[::50]]
    df = spark.createDataFrame([(cuts[:n], s) for n in (0, 1, 31, 32, 33, 1023) for s in scores], "c array<double>, s double")
    df = evaluate._cuts_below(df, "c", "s", "got")
    out = df.select("got", F.size(F.filter("c", lambda c: c < F.col("s"))).alias("want")).collect()
    assert all(r.got == r.want for r in out)
