"""Penalised GLM / GAM fitted by distributed penalised IRLS (§4.3 of the blueprint).

Plan per fit:
1. one aggregate for factor levels, one per smooth for knots (type-7 quantiles of the
   distinct values), one pass for the sum-to-zero constraint of each smooth;
2. the model frame (only the model columns) is checkpointed to the shared folder;
3. each IRLS pass is ONE Spark job: tasks build their design rows in numpy
   (Arrow batches via ``mapInPandas``) and emit one array per group (partial XᵀWX, XᵀWz
   and deviance), which :mod:`.partials` adds: the shuffled rows do not depend on p, and
   groups × (p² + p + 2) numbers reach the driver;
4. the driver solves (XᵀWX + Σλ_j S_j) β = XᵀWz and updates each λ_j by the
   Fellner–Schall rule λ_j ← (rank S_j − λ_j tr(V S_j)) / βᵀS_jβ (Wood & Fasiolo 2017).

Several models that share a design (e.g. two species, or bootstrap replicates) are
fitted together: rows carry a group id and every pass aggregates per group.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import families, partials, resample
from .splines import CubicBasis, ThinPlateBasis, place_knots_probs, sum_to_zero
from ..functions.distributions import chi2_sf_scalar
from ..operators.quantiles import exact_quantiles
from ..session import compute_partitions, ensure_checkpoint_dir, spread


#: Knots of a thin-plate basis before its rank is reduced.
TP_KNOTS = 60


# ----------------------------------------------------------------------------- terms
@dataclass
class Linear:
    col: str


@dataclass
class Factor:
    col: str
    levels: list | None = None


@dataclass
class Smooth:
    col: str
    k: int = 10
    cyclic: bool = False
    knots: list | None = None
    basis: str = "cr"  # cubic with k knots, or "tp": thin-plate of rank k on up to TP_KNOTS knots

    def probs(self) -> list[float]:
        """Where the knots lie among the distinct values."""
        return place_knots_probs(TP_KNOTS if self.basis == "tp" else self.k)

    def raw(self):
        if self.basis not in ("cr", "tp") or self.basis == "tp" and self.cyclic:
            raise ValueError(f"no such basis: {self.basis}{' (cyclic)' if self.cyclic else ''}")
        return ThinPlateBasis(self.knots, self.k) if self.basis == "tp" else CubicBasis(self.knots, cyclic=self.cyclic)


@dataclass
class Design:
    """Column layout of the model matrix and the penalties of its smooth blocks."""
    terms: list
    names: list = field(default_factory=list)
    blocks: dict = field(default_factory=dict)      # term label -> slice
    penalties: list = field(default_factory=list)   # (label, slice, S, rank)
    bases: dict = field(default_factory=dict)       # smooth col -> (basis, Z)

    @property
    def p(self):
        return len(self.names)

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        n = len(pdf)
        cols = [np.ones((n, 1))]
        for t in self.terms:
            if isinstance(t, Linear):
                cols.append(pdf[t.col].to_numpy(dtype=float).reshape(n, 1))
            elif isinstance(t, Factor):
                hot = np.zeros((n, len(t.levels)))
                hot[np.arange(n), _codes(pdf[t.col], t.levels)] = 1.0
                cols.append(hot[:, 1:])
            else:
                cols.append(self._curve(t, pdf))
        return np.concatenate(cols, axis=1)

    def _curve(self, t, pdf: pd.DataFrame) -> np.ndarray:
        """A smooth's columns; equal values are evaluated once."""
        basis, Z = self.bases[t.col]
        at, values = pd.factorize(pdf[t.col].to_numpy(dtype=float), use_na_sentinel=False)
        return (basis.evaluate(values) @ Z)[at]

    def split(self, pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        """The columns that are not of factors (the intercept first), and each factor's level of each row."""
        cols = [np.ones((len(pdf), 1))]
        for t in self.terms:
            if isinstance(t, Linear):
                cols.append(pdf[t.col].to_numpy(dtype=float).reshape(-1, 1))
            elif isinstance(t, Smooth):
                cols.append(self._curve(t, pdf))
        return np.concatenate(cols, axis=1), [_codes(pdf[t.col], t.levels) for t in self.terms if isinstance(t, Factor)]

    def places(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where the columns of ``split`` are in ``matrix``: of the plain ones, and of each factor's levels (-1: no column)."""
        plain, factors = [0], []
        for t in self.terms:
            sl = self.blocks[_label(t)]
            if isinstance(t, Factor):
                factors.append(np.concatenate([[-1], np.arange(sl.start, sl.stop)]).astype(int))
            else:
                plain += range(sl.start, sl.stop)
        return np.array(plain), factors


def _codes(column: pd.Series, levels: list) -> np.ndarray:
    """Places of the values among the levels; of values that are none, that of the first level, which has no column."""
    at, values = pd.factorize(column, use_na_sentinel=False)
    place = {str(lv): i for i, lv in enumerate(levels)}
    return np.array([place.get(str(v), 0) for v in values], dtype=np.int64)[at]


def _label(t) -> str:
    if isinstance(t, Smooth):
        return f"s({t.col})"
    return t.col


# ----------------------------------------------------------------------------- setup jobs
def _setup_design(df: DataFrame, terms: list) -> Design:
    # levels and knots found here belong to this design, not to the caller's terms
    terms = [copy.copy(t) for t in terms]
    d = Design(terms=terms, names=["(Intercept)"])
    d.blocks["(Intercept)"] = slice(0, 1)
    # all factor levels in one job: (factor, level) pairs de-duplicated map-side
    need_lv = [t for t in terms if isinstance(t, Factor) and t.levels is None]
    if need_lv:
        cols = [t.col for t in need_lv]
        rows = (df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "__f", "__l")
                .dropna().distinct().collect())
        for t in need_lv:
            t.levels = sorted(r["__l"] for r in rows if r["__f"] == t.col)
    # all knot sets in one quantile computation over each smooth's distinct values
    need_kn = [t for t in terms if isinstance(t, Smooth) and t.knots is None]
    if need_kn:
        cols = [t.col for t in need_kn]
        uniq = (df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "__s", "v")
                .dropna().distinct())
        probs = sorted({p for t in need_kn for p in t.probs()})
        q = exact_quantiles(uniq, "v", probs, ["__s"]).collect()
        for t in need_kn:
            want = set(t.probs())
            t.knots = sorted(set(float(r["quantile"]) for r in q if r["__s"] == t.col and r["prob"] in want))
    smooths = [t for t in terms if isinstance(t, Smooth)]
    raw = {t.col: t.raw() for t in smooths}
    if smooths:
        # column sums of each raw basis over the data: one pass, summed per index
        cols = [t.col for t in smooths]
        sizes = [raw[c].n_coef for c in cols]

        def sums(it):
            acc = np.zeros(sum(sizes))
            for pdf in it:
                off = 0
                for c, s in zip(cols, sizes):
                    acc[off:off + s] += raw[c].evaluate(pdf[c].to_numpy(dtype=float)).sum(axis=0)
                    off += s
            yield pd.DataFrame({"i": np.arange(len(acc), dtype=np.int32), "v": acc})
        tot = (df.select(*cols).dropna().mapInPandas(sums, "i int, v double")
               .groupBy("i").agg(F.sum("v").alias("v")).collect())
        vec = np.zeros(sum(sizes))
        for r in tot:
            vec[r["i"]] = r["v"]
        off = 0
        for c, s in zip(cols, sizes):
            d.bases[c] = (raw[c], sum_to_zero(vec[off:off + s]))
            off += s
    for t in terms:
        start = len(d.names)
        if isinstance(t, Linear):
            d.names.append(t.col)
        elif isinstance(t, Factor):
            d.names += [f"{t.col}{lv}" for lv in t.levels[1:]]
        else:
            basis, Z = d.bases[t.col]
            d.names += [f"s({t.col}).{i + 1}" for i in range(Z.shape[1])]
            S = Z.T @ basis.S @ Z
            rank = int(np.linalg.matrix_rank(S))
            d.penalties.append((_label(t), slice(start, len(d.names)), S, rank))
        d.blocks[_label(t)] = slice(start, len(d.names))
    return d


# ----------------------------------------------------------------------------- the pass
_POIS1_CDF = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(20)])


def poisson_weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) bootstrap weights (rows × replicates) from a keyed 64-bit mix of
    (seed, replicate, row id): deterministic on any partitioning."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = x + (np.arange(replicates, dtype=np.uint64)[None, :] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ np.uint64(seed & 0xFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_POIS1_CDF, u).astype(np.float64)


class _Sums:
    """Weighted sums of products of one group's design columns for R weights a row, kept by kind of column.

    Plain columns meet in one product of their pairs and the weights.  A row has one level of
    each factor, so a factor's columns are sums over the rows of its levels: rows are taken by
    combination of levels, and no row meets the columns of levels that it does not have.
    """

    def __init__(self, design: Design, replicates: int):
        self.design, self.replicates = design, replicates
        self.plain, self.factors = design.places()
        self.q = len(self.plain)
        self.upper = np.triu_indices(self.q)
        self.pairs = np.zeros((replicates, len(self.upper[0])))
        self.plain_z = np.zeros((replicates, self.q))
        # of each level: weights times plain columns (the intercept first), then weights times response
        self.levels = [np.zeros((len(f), replicates, self.q + 1)) for f in self.factors]
        self.both = {(a, b): np.zeros((len(fa), len(fb), replicates)) for a, fa in enumerate(self.factors)
                     for b, fb in enumerate(self.factors) if a < b}

    def eta(self, betas: np.ndarray, D: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
        """Linear predictors, replicates x rows."""
        out = betas[:, self.plain] @ D.T
        for f, code in zip(self.factors, codes):
            own = np.where(f >= 0, betas[:, np.maximum(f, 0)], 0.0)
            out += own[:, code]
        return out

    def add(self, D: np.ndarray, codes: list[np.ndarray], W: np.ndarray, Wz: np.ndarray) -> None:
        if self.replicates == 1:
            return self._add_one(D, codes, W[0], Wz[0])
        shape = tuple(len(f) for f in self.factors)
        cell = np.ravel_multi_index(codes, shape) if codes else np.zeros(len(D), np.int64)
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        D, W, Wz = D[order], W[:, order], Wz[:, order]
        products = D[:, self.upper[0]] * D[:, self.upper[1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(D)]):
            pairs, z = W[:, lo:hi] @ products[lo:hi], Wz[:, lo:hi] @ D[lo:hi]
            self.pairs += pairs
            self.plain_z += z
            mine = [code[order[lo]] for code in codes]
            for levels, at in zip(self.levels, mine):
                levels[at, :, :self.q] += pairs[:, :self.q]  # the first pairs are those with the intercept
                levels[at, :, self.q] += z[:, 0]
            for (a, b), sums in self.both.items():
                sums[mine[a], mine[b]] += pairs[:, 0]

    def _add_one(self, D: np.ndarray, codes: list[np.ndarray], w: np.ndarray, wz: np.ndarray) -> None:
        DW = D * w[:, None]
        self.pairs[0] += (DW.T @ D)[self.upper]
        self.plain_z[0] += D.T @ wz
        columns = np.ascontiguousarray(DW.T)
        for levels, code in zip(self.levels, codes):
            for i, column in enumerate([*columns, wz]):
                levels[:, 0, i] += np.bincount(code, column, len(levels))
        for (a, b), sums in self.both.items():
            sums[:, :, 0] += np.bincount(codes[a] * sums.shape[1] + codes[b], w, sums.shape[0] * sums.shape[1]).reshape(sums.shape[:2])

    def whole(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """XᵀWX and XᵀWz of one replicate."""
        H, z = np.zeros((self.design.p, self.design.p)), np.zeros(self.design.p)
        H[self.plain[self.upper[0]], self.plain[self.upper[1]]] = self.pairs[r]
        z[self.plain] = self.plain_z[r]
        for f, levels in zip(self.factors, self.levels):
            known = f >= 0
            H[np.ix_(self.plain, f[known])] = levels[known, r, :self.q].T
            H[f[known], f[known]] = levels[known, r, 0]
            z[f[known]] = levels[known, r, self.q]
        for (a, b), sums in self.both.items():
            fa, fb = self.factors[a], self.factors[b]
            H[np.ix_(fa[fa >= 0], fb[fb >= 0])] = sums[fa >= 0][:, fb >= 0, r]
        # each pair of columns stands once, on either side of the diagonal
        return H + H.T - np.diag(np.diag(H)), z


#: (row, replicate) pairs whose weights are made at once.
_PAIRS = 1 << 17


def _partials_fn(design: Design, fam, betas: list | None, y_col: str, off_col: str | None,
                 w_col: str | None, g_col: str, groups: list, hinvs: list | None = None,
                 boot: tuple | None = None):
    p = design.p
    gidx = {g: i for i, g in enumerate(groups)}
    size = p * p + p + 2

    def working(eta, y, off):
        mu = fam.linkinv(eta)
        me = fam.mu_eta(eta)
        return mu, me, me * me / fam.variance(mu), eta - off

    def fn(it):
        acc = np.zeros((len(groups), size))
        held: dict = {}
        exact = boot.task() if isinstance(boot, resample.Draws) else None
        for pdf in it:
            if len(pdf) == 0:
                continue
            D, codes = design.split(pdf)
            X = design.matrix(pdf) if hinvs is not None else None
            y = pdf[y_col].to_numpy(dtype=float)
            off = pdf[off_col].to_numpy(dtype=float) if off_col else np.zeros(len(pdf))
            w0 = pdf[w_col].to_numpy(dtype=float) if w_col else np.ones(len(pdf))
            pw = (exact or boot).weights(pdf) if exact or isinstance(boot, resample.WeightColumns) else poisson_weights(pdf[boot[0]].to_numpy(), boot[1], boot[2]) if boot else None
            at, values = pd.factorize(pdf[g_col])
            for place, gv in enumerate(values):
                key = gv.item() if hasattr(gv, "item") else gv
                m = np.flatnonzero(at == place)
                own = [gidx[(key, b)] for b in range(pw.shape[1])] if boot else [gidx[key]]
                if key not in held:
                    held[key] = (own, _Sums(design, len(own)))
                sums = held[key][1]
                Dg, cg, yg, og = D[m], [c[m] for c in codes], y[m], off[m]
                wg = w0[m][None, :] * pw[m].T if boot else w0[m][None, :]
                b = None if betas is None else np.stack([betas[i] for i in own])
                W, Wz = np.empty(wg.shape), np.empty(wg.shape)
                step = max(1, _PAIRS // len(own))
                for lo in range(0, len(m), step):
                    s = slice(lo, lo + step)
                    if b is None:
                        eta = np.broadcast_to(fam.start_eta(yg[s]), wg[:, s].shape)
                    else:
                        eta = sums.eta(b, Dg[s], [c[s] for c in cg]) + og[s]
                    mu, me, unit, base = working(eta, yg[s], og[s])
                    W[:, s] = wg[:, s] * unit
                    ya = yg[s]
                    if hinvs is not None:
                        # Firth: adjusted response y + h(1/2 - mu), h = W x'(X'WX)^-1 x (logit link)
                        Xs = X[m[s]]
                        hat = np.stack([W[i, s] * ((Xs @ hinvs[gi]) * Xs).sum(axis=1) if hinvs[gi] is not None else np.zeros(len(Xs))
                                        for i, gi in enumerate(own)])
                        ya = ya + hat * (0.5 - mu)
                    Wz[:, s] = W[:, s] * (base + (ya - mu) / me)
                    for i, gi in enumerate(own):
                        acc[gi, -2] += fam.deviance(yg[s], mu[i], wg[i, s])
                        acc[gi, -1] += wg[i, s].sum()
                sums.add(Dg, cg, W, Wz)
        for own, sums in held.values():
            for r, gi in enumerate(own):
                H, z = sums.whole(r)
                acc[gi, :p * p], acc[gi, p * p:p * p + p] = H.ravel(), z
        yield partials.rows({i: a for i, a in enumerate(acc) if a[-1]}, partials.task())
    return fn, size


def _run_pass(frame: DataFrame, design, fam, betas, y_col, off_col, w_col, g_col, groups, hinvs=None, boot=None):
    fn, size = _partials_fn(design, fam, betas, y_col, off_col, w_col, g_col, groups, hinvs, boot)
    tasks = frame.rdd.getNumPartitions()
    if not isinstance(boot, resample.Draws):  # those draws belong to the partitions
        # a task adds its sums over all it reads, so few tasks emit however many partitions the rows have
        tasks = min(tasks, compute_partitions(frame.sparkSession))
        frame = frame.coalesce(tasks)
    found = partials.summed(frame.mapInPandas(fn, partials.SCHEMA), tasks)
    out = np.zeros((len(groups), size))
    for i, sums in found.items():
        out[i] = sums
    p = design.p
    return [(o[:p * p].reshape(p, p), o[p * p:p * p + p], o[-2], o[-1]) for o in out]


# ----------------------------------------------------------------------------- results
@dataclass
class GamFit:
    design: Design
    family: object
    group: object
    beta: np.ndarray
    Vp: np.ndarray
    lambdas: list
    edf: np.ndarray
    deviance: float
    null_deviance: float | None
    n: float
    iterations: int
    converged: bool

    def coefficients(self) -> pd.DataFrame:
        se = np.sqrt(np.maximum(np.diag(self.Vp), 0))
        return pd.DataFrame({"term": self.design.names, "estimate": self.beta, "se": se,
                             "z": self.beta / np.where(se > 0, se, np.nan)})

    def term_table(self) -> pd.DataFrame:
        """Per term Wald χ², degrees of freedom and p-value.

        A factor or linear term is tested by βᵀV⁻¹β.  A smooth's full V holds directions that
        the penalty has nearly removed, whose β²/V is far below χ²₁, so its fitted curve is tested
        on the ``round(edf)`` leading directions of the curve's own covariance only."""
        rows = []
        information = self._information()
        for label, sl in self.design.blocks.items():
            if label == "(Intercept)" or sl.stop == sl.start:
                continue
            b = self.beta[sl]
            V = self.Vp[sl, sl]
            edf = float(self.edf[sl].sum())
            is_smooth = label.startswith("s(")
            if is_smooth:
                stat, dof = _truncated_wald(b, V, information[sl, sl], edf)
            else:
                stat, dof = float(b @ np.linalg.pinv(V) @ b), float(sl.stop - sl.start)
            pv = 1.0 if is_smooth and edf < 1e-3 else chi2_sf_scalar(stat, dof)
            rows.append({"term": label, "edf": edf, "chi_sq": stat, "df": dof,
                         "p_value": pv, "smooth": is_smooth})
        return pd.DataFrame(rows)

    def _information(self) -> np.ndarray:
        """XᵀWX at the fit: the inverse of ``Vp`` without the penalties."""
        information = np.linalg.pinv(self.Vp)
        for (_, sl, S, _), lam in zip(self.design.penalties, self.lambdas):
            information[sl, sl] -= lam * S
        return information

    def eta_se(self, pdf: pd.DataFrame):
        X = self.design.matrix(pdf)
        eta = X @ self.beta
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", X, self.Vp, X), 0))
        return eta, se


def _truncated_wald(b: np.ndarray, V: np.ndarray, gram: np.ndarray, edf: float) -> tuple[float, float]:
    """Wald statistic of a curve with (weighted) Gram matrix ``gram`` on its ``round(edf)`` leading directions, and their number."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = np.sqrt(np.maximum(values, 0.0))[:, None] * vectors.T
    var, axes = np.linalg.eigh(root @ V @ root.T)
    var, axes = var[::-1], axes[:, ::-1]
    whole = max(1, int((var > var[0] * 1e-10).sum()))
    r = int(np.clip(round(edf), 1, whole))
    scores = axes[:, :r].T @ (root @ b)
    return float((scores ** 2 / np.maximum(var[:r], 1e-300)).sum()), float(r)


def fit_gam(df: DataFrame, response: str, terms: list, family: str = "poisson", link: str | None = None,
            offset: str | None = None, weight: str | None = None, group: str | None = None,
            max_iter: int = 100, tol: float = 1e-8, factor_ridge: float = 1e-6,
            theta: float | None = None, select_lambda: bool = True, design: Design | None = None,
            start: dict | None = None, lambdas: dict | None = None, firth: bool = False,
            poisson_boot: tuple | None = None, exact_boot: resample.Draws | resample.WeightColumns | None = None) -> list[GamFit]:
    """Fit one penalised GLM per ``group`` value (one model if ``group`` is None).

    Returns one GamFit per group (order of sorted group values). Failed or
    non-converged fits are returned with ``converged=False`` rather than dropped.
    ``design`` reuses knots/levels/constraints of an earlier fit; ``start`` (group →
    β) warm-starts and ``lambdas`` (group → list) fixes the smoothing parameters.
    ``firth=True`` (binomial logit) maximises Firth's penalised likelihood (G2): each
    iteration first computes XᵀWX at the current β (one pass), then scores with the
    adjusted response y + h(½ − μ), h = W xᵀ(XᵀWX)⁻¹x, starting from β = 0.
    ``poisson_boot=(id_col, B, seed)`` fits B Poisson-bootstrap replicates of every group
    in the same passes: each row's Poisson(1) weights are generated inside the tasks
    from its id (nothing is expanded or joined); fits are keyed (group, replicate).
    ``exact_boot`` does the same for stratified resampling of exact size: the draws belong to
    the partitions of ``df``, which must be checkpointed, without nulls and have ``spread``'s partitions;
    or they stand in columns of ``df`` (``WeightColumns``).
    """
    boot = exact_boot or poisson_boot
    if firth and (family != "binomial" or (link or "logit") != "logit"):
        raise ValueError("firth=True needs family='binomial', link='logit'")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    fam = families.family(family, link, theta)
    cols = {response, *(t.col for t in terms)}
    if offset:
        cols.add(offset)
    if weight:
        cols.add(weight)
    if poisson_boot:
        cols.add(poisson_boot[0])
    if exact_boot:
        cols.update(c for c in exact_boot.columns if c != group)
    g_col = group or "__g"
    base = df if group else df.withColumn("__g", F.lit(0))
    frame = spread(base.select(g_col, *sorted(cols)).dropna())
    design = design or _setup_design(frame, terms)
    terms = design.terms
    groups = sorted(r[0] for r in frame.select(g_col).distinct().collect())
    if poisson_boot or exact_boot:
        groups = [(g, b) for g in groups for b in range(exact_boot.replicates if exact_boot else poisson_boot[1])]
    p = design.p
    lam = [list((lambdas or {}).get(g, [1.0] * len(design.penalties))) for g in groups]
    ridge = np.zeros(p)
    for t in terms:
        if isinstance(t, Factor):
            ridge[design.blocks[_label(t)]] = factor_ridge
    betas = None
    if start:
        betas = [np.asarray(start.get(g, next(iter(start.values()))), dtype=float) for g in groups]
    dev_old = [np.inf] * len(groups)
    accepted = [(np.inf, None)] * len(groups)  # Firth: criterion and coefficients of the last step
    state = {}
    converged = [False] * len(groups)
    it = 0
    for it in range(1, max_iter + 1):
        hinvs = None
        if firth:
            if betas is None:
                betas = [np.zeros(p) for _ in groups]
            # hat values need (X'WX)^-1 at the current beta: one extra pass per iteration, and one
            # more for every halving of a step that lowers the penalised likelihood
            for _ in range(20):
                pre = _run_pass(frame, design, fam, betas, response, offset, weight, g_col, groups,
                                boot=boot)
                crit = [h[2] - np.linalg.slogdet(h[0])[1] for h in pre]
                worse = [i for i, (c, (old, _)) in enumerate(zip(crit, accepted)) if not c <= old + 1e-7 * (1 + abs(old))]
                if not worse:
                    break
                betas = [(b + accepted[i][1]) / 2 if i in worse else b for i, b in enumerate(betas)]
            accepted = list(zip(crit, betas))
            hinvs = [np.linalg.pinv(h[0]) for h in pre]
        parts = _run_pass(frame, design, fam, betas, response, offset, weight, g_col, groups, hinvs,
                          boot)
        new_betas = []
        for gi, (H, r, dev, n) in enumerate(parts):
            def solve(lams):
                S = np.diag(ridge)
                for (label, sl, Sj, rank), l in zip(design.penalties, lams):
                    S[sl, sl] += l * Sj
                try:
                    V = np.linalg.inv(H + S)
                except np.linalg.LinAlgError:
                    V = np.linalg.pinv(H + S)
                return V, V @ r
            V, b = solve(lam[gi])
            if select_lambda and betas is not None and design.penalties:
                # performance iteration: with this pass's working weights fixed, iterate the
                # Fellner-Schall update on the p x p system (driver only, no extra jobs)
                for _ in range(200):
                    old = list(lam[gi])
                    for j, (label, sl, Sj, rank) in enumerate(design.penalties):
                        bSb = float(b[sl] @ Sj @ b[sl])
                        trVS = float(np.trace(V[sl, sl] @ Sj))
                        num = rank - lam[gi][j] * trVS
                        if bSb > 1e-300 and num > 0:
                            lam[gi][j] = float(np.clip(num / bSb, 1e-8, 1e12))
                        else:
                            lam[gi][j] = float(np.clip(lam[gi][j] * 10.0, 1e-8, 1e12))
                    V, b = solve(lam[gi])
                    if all(abs(np.log(a) - np.log(o)) < 1e-4 for a, o in zip(lam[gi], old)):
                        break
            edf = np.diag(V @ H)
            if not np.all(np.isfinite(b)):
                b = betas[gi] if betas is not None else np.zeros(p)
            state[gi] = (b, V, edf, dev, n, None)
            converged[gi] = bool(np.isfinite(dev_old[gi])) and abs(dev - dev_old[gi]) <= tol * (0.1 + abs(dev))
            dev_old[gi] = dev
            new_betas.append(b)
        if all(converged):
            break
        betas = new_betas
    out = []
    for gi, g in enumerate(groups):
        b, V, edf, dev, n, _ = state[gi]
        out.append(GamFit(design, fam, g, b, V, lam[gi], edf, dev, None, n, it, converged[gi]))
    return out


def predict_frame(fits: dict, grid: DataFrame, group_col: str | None = None,
                  eta_col: str = "eta", se_col: str = "se") -> DataFrame:
    """M1: link-scale prediction and standard error √(xᵀVx) for each grid row.

    ``fits`` maps group value → GamFit (use key None with ``group_col=None``)."""
    from pyspark.sql import types as T
    out_schema = T.StructType(grid.schema.fields + [T.StructField(eta_col, T.DoubleType()),
                                                    T.StructField(se_col, T.DoubleType())])

    def fn(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            eta = np.full(len(pdf), np.nan)
            se = np.full(len(pdf), np.nan)
            keys = pdf[group_col].to_numpy() if group_col else np.array([None] * len(pdf))
            for k in pd.unique(keys):
                m = keys == k if group_col else np.ones(len(pdf), bool)
                f = fits.get(k.item() if hasattr(k, "item") else k)
                if f is None:
                    continue
                e, s = f.eta_se(pdf[m])
                eta[m], se[m] = e, s
            yield pdf.assign(**{eta_col: eta, se_col: se})
    return grid.mapInPandas(fn, out_schema)
