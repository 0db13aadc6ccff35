"""Random-intercept linear mixed model fitted by profile REML (G9) and its effects.

y = Xβ + b_g + ε with b_g ~ N(0, σ_b²), ε ~ N(0, σ²). With γ = σ_b²/σ² the inverse
covariance of group g is (I − c_g 11ᵀ)/σ², c_g = γ/(1 + γ n_g), so every REML
quantity is a function of global XᵀX, Xᵀy, yᵀy and per-group (n_g, s_g = X_gᵀ1,
t_g = 1ᵀy_g). One Spark pass gathers them (numpy partials per Arrow batch, summed by
key); REML is then maximised over log γ on the driver, and group BLUPs are
c_g (t_g − s_gᵀβ̂).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gam import Design, _setup_design
from ..session import ensure_checkpoint_dir, spread


@dataclass
class MixedFit:
    design: Design
    beta: np.ndarray
    vcov: np.ndarray
    sigma2: float
    sigma2_group: float
    gamma: float
    reml: float
    blups: dict
    n: int

    def coefficients(self) -> pd.DataFrame:
        se = np.sqrt(np.diag(self.vcov))
        return pd.DataFrame({"term": self.design.names, "estimate": self.beta, "se": se, "t": self.beta / se})

    def predict(self, pdf: pd.DataFrame, group_col: str | None = None):
        X = self.design.matrix(pdf)
        eta = X @ self.beta
        if group_col:
            eta = eta + np.array([self.blups.get(g, 0.0) for g in pdf[group_col]])
        se = np.sqrt(np.einsum("ij,jk,ik->i", X, self.vcov, X))
        return eta, se


def _stats(frame: DataFrame, design: Design, y: str, group: str):
    p = design.p

    def fn(it):
        glob = np.zeros(p * p + p + 2)
        per = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            X = design.matrix(pdf)
            yy = pdf[y].to_numpy(dtype=float)
            glob[:p * p] += (X.T @ X).ravel()
            glob[p * p:p * p + p] += X.T @ yy
            glob[-2] += yy @ yy
            glob[-1] += len(yy)
            g = pdf[group].astype(str).to_numpy()
            for gv in np.unique(g):
                m = g == gv
                acc = per.setdefault(gv, np.zeros(p + 2))
                acc[:p] += X[m].sum(axis=0)
                acc[p] += yy[m].sum()
                acc[p + 1] += m.sum()
        keys, idx, vals = ["__global__"] * len(glob), list(range(len(glob))), list(glob)
        for gv, acc in per.items():
            keys += [gv] * len(acc)
            idx += list(range(len(acc)))
            vals += list(acc)
        yield pd.DataFrame({"g": keys, "i": np.array(idx, dtype=np.int32), "v": vals})
    rows = (frame.mapInPandas(fn, "g string, i int, v double").groupBy("g", "i")
            .agg(F.sum("v").alias("v")).collect())
    glob = np.zeros(p * p + p + 2)
    per = {}
    for r in rows:
        if r["g"] == "__global__":
            glob[r["i"]] = r["v"]
        else:
            per.setdefault(r["g"], np.zeros(p + 2))[r["i"]] = r["v"]
    XtX = glob[:p * p].reshape(p, p)
    Xty = glob[p * p:p * p + p]
    return XtX, Xty, glob[-2], int(round(glob[-1])), per


def _profile(gamma, XtX, Xty, yty, N, S, t, n):
    c = gamma / (1.0 + gamma * n)
    A = XtX - (S * c[:, None]).T @ S
    b = Xty - S.T @ (c * t)
    beta = np.linalg.solve(A, b)
    r = yty - np.sum(c * t * t) - b @ beta
    p = len(beta)
    sigma2 = r / (N - p)
    sign, logdet = np.linalg.slogdet(A)
    ll = -0.5 * ((N - p) * math.log(sigma2) + np.sum(np.log1p(gamma * n)) + logdet + (N - p))
    return ll, beta, sigma2, A


def fit_random_intercept(df: DataFrame, response: str, terms: list, group: str) -> MixedFit:
    """REML fit of response ~ fixed terms + (1 | group)."""
    ensure_checkpoint_dir(df.sparkSession)
    cols = sorted({response, group, *(t.col for t in terms)})
    frame = spread(df.select(*cols).dropna())
    design = _setup_design(frame, terms)
    XtX, Xty, yty, N, per = _stats(frame, design, response, group)
    keys = sorted(per)
    p = design.p
    S = np.array([per[k][:p] for k in keys])
    t = np.array([per[k][p] for k in keys])
    n = np.array([per[k][p + 1] for k in keys])
    # grid then golden-section search on log γ
    grid = np.linspace(-12, 8, 81)
    lls = [_profile(math.exp(lg), XtX, Xty, yty, N, S, t, n)[0] for lg in grid]
    i = int(np.argmax(lls))
    lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    gr = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    for _ in range(80):
        c1, c2 = b - gr * (b - a), a + gr * (b - a)
        if _profile(math.exp(c1), XtX, Xty, yty, N, S, t, n)[0] >= _profile(math.exp(c2), XtX, Xty, yty, N, S, t, n)[0]:
            b = c2
        else:
            a = c1
    lg = (a + b) / 2
    gamma = math.exp(lg)
    ll, beta, sigma2, A = _profile(gamma, XtX, Xty, yty, N, S, t, n)
    c = gamma / (1.0 + gamma * n)
    blups = {k: float(ci * (ti - si @ beta)) for k, ci, ti, si in zip(keys, c, t, S)}
    return MixedFit(design, beta, sigma2 * np.linalg.inv(A), float(sigma2), float(gamma * sigma2), gamma,
                    float(ll), blups, N)


def predict_mixed(fit: MixedFit, grid: DataFrame, group_col: str | None = None) -> DataFrame:
    """Prediction (fixed effects + the row's group BLUP) and its SE from the
    fixed-effect covariance, for each grid row."""
    from pyspark.sql import types as T
    schema = T.StructType(grid.schema.fields + [T.StructField("pred", T.DoubleType()),
                                                T.StructField("se", T.DoubleType())])

    def fn(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            e, s = fit.predict(pdf, group_col)
            yield pdf.assign(pred=e, se=s)
    return grid.mapInPandas(fn, schema)
