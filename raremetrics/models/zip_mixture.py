"""Zero-inflated mixtures (G7), Poisson or negative binomial: P(0) = π + (1−π)f(0), P(k) = (1−π)f(k),
logit π = Zγ (zero part), log λ = Xβ + offset (count part), variance λ + λ²/θ, maximum likelihood.

Each iteration is one Spark pass returning, per group, the observed log-likelihood,
its gradient and exact Hessian in (γ, β, log θ) — (p_z + p_c + 1)² numbers — from numpy
partials over Arrow batches. A few EM-style warm-up steps (E-step posterior of a structural
zero, then one weighted IRLS step per part) start Newton–Raphson with step halving.
Standard errors come from the inverse observed information.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import partials
from .gam import Design, _setup_design
from ..session import compute_partitions, ensure_checkpoint_dir, spread


@dataclass
class ZipFit:
    group: object
    zero_design: Design
    count_design: Design
    gamma: np.ndarray
    beta: np.ndarray
    vcov: np.ndarray
    loglik: float
    iterations: int
    converged: bool
    theta: float | None = None

    def coefficients(self) -> pd.DataFrame:
        se = np.sqrt(np.maximum(np.diag(self.vcov), 0))
        pz = len(self.gamma)
        rows = [{"part": "zero", "term": n, "estimate": e, "se": s}
                for n, e, s in zip(self.zero_design.names, self.gamma, se[:pz])]
        rows += [{"part": "count", "term": n, "estimate": e, "se": s}
                 for n, e, s in zip(self.count_design.names, self.beta, se[pz:])]
        if self.theta is not None:
            rows.append({"part": "count", "term": "log(theta)", "estimate": math.log(self.theta), "se": se[-1]})
        out = pd.DataFrame(rows)
        out["z"] = out["estimate"] / out["se"]
        return out


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log Γ for positive x: recurrence up to 8, then the asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (x < 8).any():
        out -= np.where(x < 8, 1 / x, 0.0)
        x = np.where(x < 8, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of log Γ for positive x."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (x < 8).any():
        out += np.where(x < 8, 1 / (x * x), 0.0)
        x = np.where(x < 8, x + 1, x)
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Γ of each element; counts repeat, so distinct values are few."""
    return _by_value(lambda value: np.array([math.lgamma(v) for v in value]), x)


def _by_value(fn, x: np.ndarray) -> np.ndarray:
    """``fn`` of each element, called on the distinct ones."""
    at, value = pd.factorize(x, use_na_sentinel=False)
    return fn(value)[at]


def count_part(y: np.ndarray, ec: np.ndarray, theta: float | None) -> tuple[np.ndarray, ...]:
    """Log density of counts with log mean ``ec`` and its derivatives: l, l_c, l_t, l_cc, l_ct, l_tt.

    c is the log mean, t the log of θ (variance μ + μ²/θ); without θ the counts are Poisson."""
    lam = np.exp(ec)
    if theta is None:
        none = np.zeros(len(y))
        return y * ec - lam - _log_gamma(y + 1.0), y - lam, none, -lam, none, none
    s = lam + theta
    l = _log_gamma(y + theta) - math.lgamma(theta) - _log_gamma(y + 1.0) + theta * math.log(theta) + y * ec - (y + theta) * np.log(s)
    first = _by_value(digamma, y + theta) - digamma(np.array(theta)) + math.log(theta) + 1 - np.log(s) - (y + theta) / s
    second = _by_value(trigamma, y + theta) - trigamma(np.array(theta)) + 1 / theta - 2 / s + (y + theta) / (s * s)
    return (l, theta * (y - lam) / s, theta * first, -(y + theta) * lam * theta / (s * s),
            theta * (y - lam) * lam / (s * s), theta * first + theta * theta * second)


def mixture_part(y: np.ndarray, ez: np.ndarray, ec: np.ndarray, theta: float | None):
    """Log likelihood of each row, its gradient (3 x n) and Hessian (3 x 3 x n) in (zero predictor, log mean, log θ),
    and the probability that a zero is structural."""
    pi = 1.0 / (1.0 + np.exp(-ez))
    zero = y == 0
    l, c, t, cc, ct, tt = count_part(y, ec, theta)
    q = np.exp(np.where(zero, l, 0.0))
    p0 = np.maximum(pi + (1 - pi) * q, 1e-300)
    mass = (1 - pi) * q
    # of p0 for zeros
    d = np.stack([pi * (1 - pi) * (1 - q), mass * c, mass * t])
    dd = np.empty((3, 3, len(y)))
    dd[0, 0] = pi * (1 - pi) * (1 - 2 * pi) * (1 - q)
    dd[0, 1] = dd[1, 0] = -pi * mass * c
    dd[0, 2] = dd[2, 0] = -pi * mass * t
    dd[1, 1], dd[2, 2] = mass * (c * c + cc), mass * (t * t + tt)
    dd[1, 2] = dd[2, 1] = mass * (c * t + ct)
    grad = np.where(zero, d / p0, np.stack([-pi, c, t]))
    none = np.zeros(len(y))
    plain = np.array([[-pi * (1 - pi), none, none], [none, cc, ct], [none, ct, tt]])
    hess = np.where(zero, dd / p0 - (d[:, None] / p0) * (d[None, :] / p0), plain)
    return np.where(zero, np.log(p0), np.log1p(-pi) + l), grad, hess, np.where(zero, pi / p0, 0.0)


def _pass(frame, zd: Design, cd: Design, y_col, off_col, g_col, groups, params, em: bool, negbin: bool):
    """Per group: log-likelihood, gradient and Hessian in (γ, β and, with ``negbin``, log θ), and the EM step's systems."""
    pz, pc = zd.p, cd.p
    q = pz + pc + negbin
    gidx = {g: i for i, g in enumerate(groups)}
    size = 1 + q + q * q + (pz * pz + pz + pc * pc + pc)

    def fn(it):
        acc: dict[int, np.ndarray] = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            Z, X = zd.matrix(pdf), cd.matrix(pdf)
            y = pdf[y_col].to_numpy(dtype=float)
            off = pdf[off_col].to_numpy(dtype=float) if off_col else np.zeros(len(pdf))
            g = pdf[g_col].to_numpy()
            for gv in np.unique(g):
                m = g == gv
                gi = gidx[gv.item() if hasattr(gv, "item") else gv]
                gam_, bet, t = params[gi]
                theta = math.exp(t) if negbin else None
                Zg, Xg, yg = Z[m], X[m], y[m]
                ez = np.clip(Zg @ gam_, -30, 30)
                ec = np.clip(Xg @ bet + off[m], -30, 30)
                ll, d, h, w0 = mixture_part(yg, ez, ec, theta)
                columns = (Zg, Xg, np.ones((len(yg), 1)))[:2 + negbin]
                H = np.block([[a.T @ (b * h[i, j][:, None]) for j, b in enumerate(columns)] for i, a in enumerate(columns)])
                parts = [np.array([ll.sum()]), *[a.T @ d[i] for i, a in enumerate(columns)], H.ravel()]
                if em:
                    pi, lam = 1.0 / (1.0 + np.exp(-ez)), np.exp(ec)
                    wz = np.maximum(pi * (1 - pi), 1e-10)
                    wc = (1 - w0) * (lam if theta is None else lam / (1 + lam / theta))
                    zz = ez + (w0 - pi) / wz
                    zc = (ec - off[m]) + (yg - lam) / np.maximum(lam, 1e-10)
                    parts += [(Zg.T @ (Zg * wz[:, None])).ravel(), Zg.T @ (wz * zz), (Xg.T @ (Xg * wc[:, None])).ravel(), Xg.T @ (wc * zc)]
                else:
                    parts.append(np.zeros(size - 1 - q - q * q))
                acc[gi] = acc.get(gi, 0) + np.concatenate(parts)
        yield partials.rows(acc, partials.task())

    tasks = min(frame.rdd.getNumPartitions(), compute_partitions(frame.sparkSession))
    found = partials.summed(frame.coalesce(tasks).mapInPandas(fn, partials.SCHEMA), tasks)
    res = []
    for gi in range(len(groups)):
        o = found.get(gi, np.zeros(size))
        k = 1 + q + q * q
        em_parts = (o[k:k + pz * pz].reshape(pz, pz), o[k + pz * pz:k + pz * pz + pz],
                    o[k + pz * pz + pz:k + pz * pz + pz + pc * pc].reshape(pc, pc), o[k + pz * pz + pz + pc * pc:])
        res.append((o[0], o[1:1 + q], o[1 + q:k].reshape(q, q), em_parts))
    return res


def _newton(grad: np.ndarray, H: np.ndarray) -> np.ndarray:
    """Newton step uphill; where the Hessian is not negative definite its eigenvalues are turned so."""
    if not (np.isfinite(H).all() and np.isfinite(grad).all()):
        return np.zeros(len(grad))
    e, v = np.linalg.eigh(-H)
    e = np.maximum(np.abs(e), 1e-8 * max(1.0, np.abs(e).max()))
    step = v @ ((v.T @ grad) / e)
    return step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))


def fit_zip(df: DataFrame, count: str, count_terms: list, zero_terms: list, group: str | None = None,
            offset: str | None = None, em_steps: int = 5, max_iter: int = 100, tol: float = 1e-9,
            family: str = "poisson") -> dict:
    """Fit the mixture per group, with Poisson or (``family='negbin'``) negative-binomial counts; returns {group: ZipFit}.

    With negative-binomial counts log θ is one more parameter of every pass: its gradient and
    its second derivatives with both predictors are in the Newton step."""
    if family not in ("poisson", "negbin"):
        raise ValueError(family)
    negbin = family == "negbin"
    ensure_checkpoint_dir(df.sparkSession)
    g_col = group or "__g"
    base = df if group else df.withColumn("__g", F.lit(0))
    cols = sorted({count, *(t.col for t in count_terms), *(t.col for t in zero_terms)} | ({offset} if offset else set()))
    frame = spread(base.select(g_col, *cols).dropna())
    zd, cd = _setup_design(frame, zero_terms), _setup_design(frame, count_terms)
    groups = sorted(r[0] for r in frame.select(g_col).distinct().collect())
    means = {r[g_col]: r["m"] for r in frame.groupBy(g_col).agg(F.avg(count).alias("m")).collect()}
    params = []
    for g in groups:
        b0 = np.zeros(cd.p)
        b0[0] = math.log(max(means[g], 1e-6))
        params.append((np.zeros(zd.p), b0, 0.0))
    pz, pc = zd.p, cd.p
    ll_old = [-np.inf] * len(groups)
    done = [False] * len(groups)
    it = 0
    last = None
    for it in range(1, em_steps + max_iter + 1):
        em = it <= em_steps
        res = _pass(frame, zd, cd, count, offset, g_col, groups, params, em, negbin)
        new = []
        for gi, (ll, grad, H, emp) in enumerate(res):
            gam_, bet, t = params[gi]
            if not em and (not np.isfinite(ll) or ll < ll_old[gi] - 1e-9 * abs(ll_old[gi])) and last is not None and last[gi] is not None:
                # step made things worse: halve it from the previous accepted point
                before, step = last[gi]
                step = step / 2.0
                new.append((before[0] + step[:pz], before[1] + step[pz:pz + pc], before[2] + (step[-1] if negbin else 0.0)))
                last[gi] = (before, step)
                continue
            done[gi] = (not em) and abs(ll - ll_old[gi]) <= tol * (1.0 + abs(ll))
            ll_old[gi] = ll
            if em:
                Azz, bz, Acc, bc = emp
                new.append((np.linalg.pinv(Azz) @ bz, np.linalg.pinv(Acc) @ bc, t))
                if it == em_steps:
                    ll_old[gi] = -np.inf  # the steps of the EM start need not be uphill
            else:
                step = _newton(grad, H)
                if last is None:
                    last = [None] * len(groups)
                last[gi] = (params[gi], step)
                new.append((gam_ + step[:pz], bet + step[pz:pz + pc], t + (step[-1] if negbin else 0.0)))
        if all(done):
            break
        params = new
    final = _pass(frame, zd, cd, count, offset, g_col, groups, params, False, negbin)
    out = {}
    for gi, g in enumerate(groups):
        ll, grad, H, _ = final[gi]
        vc = np.linalg.pinv(-H)
        gam_, bet, t = params[gi]
        out[g] = ZipFit(g, zd, cd, gam_, bet, vc, float(ll), it, bool(done[gi]), math.exp(t) if negbin else None)
    return out
