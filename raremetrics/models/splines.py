"""Spline bases with their wiggliness penalties: cubic (natural and cyclic) and thin-plate.

A cubic spline is parameterised by its values β at the knots; second derivatives δ at
the knots solve B δ = D β, so the value at x is linear in β:
f(x) = a⁻β_j + a⁺β_{j+1} + c⁻δ_j + c⁺δ_{j+1} on [x_j, x_{j+1}], and the penalty
∫f''² = βᵀ Dᵀ B⁻¹ D β (Wood 2017, §5.3.1-5.3.2). Only k×k algebra on the driver;
rows are evaluated in numpy inside Spark tasks.
"""

from __future__ import annotations

import numpy as np


def _natural_matrices(knots: np.ndarray):
    k = len(knots)
    h = np.diff(knots)
    B = np.zeros((k - 2, k - 2))
    D = np.zeros((k - 2, k))
    for i in range(k - 2):
        B[i, i] = (h[i] + h[i + 1]) / 3.0
        if i + 1 < k - 2:
            B[i, i + 1] = h[i + 1] / 6.0
            B[i + 1, i] = h[i + 1] / 6.0
        D[i, i] = 1.0 / h[i]
        D[i, i + 1] = -1.0 / h[i] - 1.0 / h[i + 1]
        D[i, i + 2] = 1.0 / h[i + 1]
    Fm = np.zeros((k, k))
    Fm[1:-1, :] = np.linalg.solve(B, D)
    S = D.T @ np.linalg.solve(B, D)
    return Fm, S


def _cyclic_matrices(knots: np.ndarray):
    k = len(knots)          # knots[-1] is the same point as knots[0] one period later
    m = k - 1
    h = np.diff(knots)      # m intervals
    B = np.zeros((m, m))
    D = np.zeros((m, m))
    for i in range(m):
        hp, hi = h[i - 1], h[i]   # interval before knot i (cyclic) and after it
        B[i, i] = (hp + hi) / 3.0
        B[i, (i - 1) % m] += hp / 6.0
        B[i, (i + 1) % m] += hi / 6.0
        D[i, i] = -1.0 / hp - 1.0 / hi
        D[i, (i - 1) % m] += 1.0 / hp
        D[i, (i + 1) % m] += 1.0 / hi
    Fm = np.linalg.solve(B, D)
    S = D.T @ np.linalg.solve(B, D)
    return Fm, S


class CubicBasis:
    """Natural (``cyclic=False``) or cyclic cubic regression spline on given knots."""

    def __init__(self, knots, cyclic: bool = False):
        self.knots = np.asarray(sorted(knots), dtype=float)
        self.cyclic = cyclic
        if cyclic:
            self.F, self.S = _cyclic_matrices(self.knots)
        else:
            self.F, self.S = _natural_matrices(self.knots)
        self.n_coef = self.F.shape[1]

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        """Basis matrix (len(x) × n_coef). Outside the knot range: linear extrapolation
        (natural) or wrap-around by the period (cyclic)."""
        kn = self.knots
        x = np.asarray(x, dtype=float)
        if self.cyclic:
            period = kn[-1] - kn[0]
            x = kn[0] + np.mod(x - kn[0], period)
        n, k = len(x), len(kn)
        X = np.zeros((n, self.n_coef))
        xc = np.clip(x, kn[0], kn[-1])
        j = np.clip(np.searchsorted(kn, xc, side="right") - 1, 0, k - 2)
        h = kn[j + 1] - kn[j]
        am = (kn[j + 1] - xc) / h
        ap = (xc - kn[j]) / h
        cm = ((kn[j + 1] - xc) ** 3 / h - h * (kn[j + 1] - xc)) / 6.0
        cp = ((xc - kn[j]) ** 3 / h - h * (xc - kn[j])) / 6.0
        jn = (j + 1) % self.n_coef if self.cyclic else j + 1
        rows = np.arange(n)
        X[rows, j] += am
        X[rows, jn] += ap
        X += cm[:, None] * self.F[j, :] + cp[:, None] * self.F[jn, :]
        if not self.cyclic:
            # linear extrapolation beyond the end knots using the end slopes
            lo, hi = x < kn[0], x > kn[-1]
            if lo.any() or hi.any():
                d0 = self._slope(0)
                d1 = self._slope(k - 2, right=True)
                X[lo] = self._row_at(0)[None, :] + (x[lo] - kn[0])[:, None] * d0[None, :]
                X[hi] = self._row_at(k - 1)[None, :] + (x[hi] - kn[-1])[:, None] * d1[None, :]
        return X

    def _row_at(self, i):
        r = np.zeros(self.n_coef)
        r[i] = 1.0
        return r

    def _slope(self, j, right=False):
        kn = self.knots
        h = kn[j + 1] - kn[j]
        r = np.zeros(self.n_coef)
        r[j] -= 1.0 / h
        r[j + 1] += 1.0 / h
        if right:   # derivative at the right end of interval j
            r += (h / 6.0) * self.F[j, :] + (h / 3.0) * self.F[j + 1, :]
        else:       # derivative at the left end of interval j
            r += (-h / 3.0) * self.F[j, :] - (h / 6.0) * self.F[j + 1, :]
        return r


class ThinPlateBasis:
    """Rank-reduced thin-plate regression spline of one variable (Wood 2003), second-derivative penalty.

    A thin-plate spline on knots is f(x) = Σ δ_i |x − x_i|³ / 12 + a + b x with Σ δ_i = Σ δ_i x_i = 0, and
    ∫f''² = δᵀEδ for E_ij = |x_i − x_j|³ / 12.  Of the δ only the space of the ``k`` largest eigenvalues of E
    is kept (in magnitude), which changes the fit least; the constraint leaves ``k`` − 2
    penalised coefficients, and constant and slope follow them.  ``x`` is in units of the knots' range.
    """

    cyclic = False

    def __init__(self, knots, k: int):
        self.knots = np.unique(np.asarray(knots, dtype=float))
        if len(self.knots) < 3:
            raise ValueError("a thin-plate spline needs three knots at least")
        self.centre, self.scale = self.knots.mean(), np.ptp(self.knots)
        at = self._unit(self.knots)
        k = min(max(k, 3), len(at))
        e, u = np.linalg.eigh(np.abs(at[:, None] - at[None, :]) ** 3 / 12)
        largest = np.argsort(-np.abs(e), kind="stable")[:k]
        e, u = e[largest], u[:, largest]
        constraint = np.stack([np.ones(len(at)), at], axis=1).T @ u
        free = np.linalg.svd(constraint)[2][2:].T
        self.weights = u @ free
        self.n_coef = k
        self.S = np.zeros((k, k))
        self.S[:k - 2, :k - 2] = free.T @ (e[:, None] * free)
        self.S = (self.S + self.S.T) / 2

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        """Basis matrix (len(x) × n_coef); linear beyond the knots, as the constraint on δ makes it."""
        at, knots = self._unit(np.asarray(x, dtype=float)), self._unit(self.knots)
        bent = np.abs(at[:, None] - knots[None, :])
        return np.column_stack([bent ** 3 / 12 @ self.weights, np.ones(len(at)), at])


def sum_to_zero(col_sums: np.ndarray) -> np.ndarray:
    """Null-space basis Z (k × k−1) of the constraint cᵀβ = 0 (Householder, as in QR)."""
    c = np.asarray(col_sums, dtype=float)
    k = len(c)
    v = c.copy()
    v[0] += np.sign(c[0] if c[0] != 0 else 1.0) * np.linalg.norm(c)
    Hh = np.eye(k) - 2.0 * np.outer(v, v) / (v @ v)
    return Hh[:, 1:]


def place_knots_probs(k: int) -> list[float]:
    """Knots evenly through the sorted unique values: probabilities for a type-7 quantile."""
    return [i / (k - 1) for i in range(k)]
