"""Whitening components of embeddings by shifted CholeskyQR.

The centred rows A (n by d) are never gathered.  Every pass applies the triangular factors
found so far to its rows (Q = A R1^-1 R2^-1 ..., by forward substitution), adds up Q'Q in
the tasks and brings d x d numbers to the driver, whose Cholesky factor is the next one.
The first Gram matrix is shifted, so that its factor exists however badly conditioned A is,
and the following passes bring Q to orthogonality.  With the composed factor R, A = Q R,
and R = U diag(s) W' gives the covariance's eigenvalues s**2 / n and its eigenvectors W
without ever squaring A's condition.  The whitened rows are sqrt(n) Q U.

Entries are fixed-point integers, so sums and distances from the mean are exact.

Defined cases: a vector that is null, or holds a null, an infinite or undefined entry or
one beyond 2**45, is left out; so is one whose length is not the most frequent one (of
equally frequent lengths the longest counts) and one without entries; repeated rows and
null ids are rows like others; a component without variance (singular value below ``NONE`` of the
largest) has null ``whitened`` and takes no part in ``identity_error``; with one row, or equal rows only, all are null, and ``explained`` too; ``deviation`` is null where
it exceeds a long; an empty table gives an empty result; extra columns are carried along
(those named like a result are replaced).
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raremetrics.llm import common

SCALE = 64
COMPONENTS = 32
#: Rows of one step in a task.
STEP_ROWS = 4096
#: Orthogonalisation passes: three settle any matrix of full rank; more only follow a lack of it.
PASSES = 6
LIMIT = 2.0**45
#: A singular value below this share of the largest is rounding.
NONE = 1e-11


def finite(vector: Column) -> Column:
    """The vector has entries, and all are numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LIMIT)), F.lit(False))


def fixed_point(column: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) of the entries, rows by dimensions; the contract's x less its constant, which no result feels."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d)


def _steps(batches, place: int, d: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(lo, STEP_ROWS)
            yield part, fixed_point(part.column(place), d)


def solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows q with q r = a, for upper triangular ``r``, by forward substitution."""
    q = np.empty_like(a)
    for j in range(r.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """Rows less the mean: the difference is exact before it is rounded once."""
    return differences(x, sums, n).astype(np.float64) / n


def differences(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """n x - S, exact: as 64-bit integers where they fit, else as Python's."""
    largest = int(np.abs(x).max(initial=0)) * n + int(np.abs(sums.astype(np.float64)).max(initial=0))
    if largest < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> pa.Array:
    """Sum over the dimensions of (n x - S)**2, exact; null beyond a long."""
    d = differences(x, sums, n)
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(d.shape[1], 1) >= 1 << 63:
        d = d.astype(object)
    total = (d * d).sum(axis=1)
    return pa.array([int(t) if int(t) < 1 << 63 else None for t in total], pa.int64()) if d.dtype == object else pa.array(total)


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the tasks' rows (i, values) by i: no task holds more than one sum, the driver one row for each i."""

    def run(batches):
        last, total = None, None
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != last:
                    if last is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["i", "values"])
                    last, total = i, np.zeros(len(raw) // 8)
                total = total + np.frombuffer(raw)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["i", "values"])

    found = parts.repartition("i").sortWithinPartitions("i").transform(common.in_tasks, run, "i int, values binary").collect()
    return {r["i"]: np.frombuffer(r["values"]) for r in found}


def gram(vectors: DataFrame, d: int, rows_of) -> np.ndarray:
    """Sum of q'q over the rows q that ``rows_of`` makes of the fixed-point vectors; one row of the matrix a task and row."""

    def run(batches):
        total = None
        for _, x in _steps(batches, 0, d):
            q = rows_of(x)
            total = (0 if total is None else total) + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([t.tobytes() for t in total], pa.binary())], names=["i", "values"])

    rows = added(vectors.transform(common.in_tasks, run, "i int, values binary"))
    out = np.stack([rows[i] for i in sorted(rows)])
    return (out + out.T) / 2


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor of ``g``, or of ``g`` with the smallest shift that rounding calls for (and more until it exists)."""
    d = len(g)
    least = 11 * (n * d + d * (d + 1)) * np.finfo(np.float64).eps / 2 * np.linalg.norm(g, 2)
    shift = min(least, 1e-3 * np.trace(g)) if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 1e-14 * np.trace(g))


@dataclasses.dataclass
class Whitening:
    """A fitted whitening: ``scores`` takes centred rows to whitened ones."""

    n: int
    sums: np.ndarray
    factors: list[np.ndarray]
    left: np.ndarray  # sqrt(n) U of the leading components
    vectors: np.ndarray  # the components, by columns
    eigenvalues: np.ndarray
    trace: float
    passes: int
    identity_error: float | None = None

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        q = centred(x, self.sums, self.n)
        for r in self.factors:
            q = solve(q, r)
        return q

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.orthogonal(x) @ self.left


def usable(table: DataFrame, column: str) -> tuple[DataFrame, int, int]:
    """The rows whose vector counts, their number and their dimension."""
    kept = table.filter(finite(F.col(column)))
    sizes = kept.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    n, d = (sizes[0]["n"], sizes[0]["d"]) if sizes else (0, 0)
    return kept.filter(F.size(column) == d).withColumn(column, F.col(column).cast("array<double>")), n, d


def fit(vectors: DataFrame, n: int, d: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of a table of one column of vectors, all of dimension ``d``."""

    def add_up(batches):
        total = np.zeros(d, object)  # no sum of any number of rows overflows
        for _, x in _steps(batches, 0, d):
            total = total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([int(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    # as many rows a task as dimensions, added up before and after the shuffle
    found = vectors.transform(common.in_tasks, add_up, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    sums = np.array([int(r["s"]) for r in sorted(found, key=lambda r: r["i"])], object)
    if max(abs(s) for s in sums) < 1 << 62:
        sums = sums.astype(np.int64)

    factors: list[np.ndarray] = []
    composed = np.eye(d)
    for k in range(PASSES):
        model = Whitening(n, sums, factors, np.eye(d), np.eye(d), np.zeros(d), 0.0, k)
        g = gram(vectors, d, model.orthogonal)
        if not g.any():  # equal rows only
            break
        r = factor(g, n, shifted=k == 0)
        factors = [*factors, r]
        composed = r @ composed
        # after this factor the rows are as orthogonal as rounding allows
        if k and np.abs(g - np.eye(d)).max() < 1e-10:
            break
    u, s, w = np.linalg.svd(composed if factors else np.zeros((d, d)))
    k = min(components, d)
    rank = int((s > NONE * max(s[0], 1e-300)).sum()) if factors else 0
    left = np.sqrt(n) * u[:, :k]
    left[:, rank:] = np.nan
    fitted = Whitening(n, sums, factors, left, w[:k].T, s[:k] ** 2 / n, float((s**2).sum() / n), len(factors))
    if min(rank, k):
        both = dataclasses.replace(fitted, left=left[:, :rank])
        # the mean of the whitened rows: a column of ones in the same pass
        g = gram(vectors, d, lambda x: np.column_stack([both.scores(x), np.ones(len(x))]))
        mean = g[-1, :-1] / n
        fitted.identity_error = float(np.abs(g[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return fitted


RESULT = (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))


def whitened(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``table`` without the vectors, a row for each usable vector and component, with the columns of ``RESULT``."""
    names = [x for x, _ in RESULT]
    carried = [c for c in table.columns if c not in (column, *names)]
    schema = table.select(*carried).schema
    for name, kind in RESULT:
        schema = schema.add(name, kind)
    rows, n, d = usable(table, column)
    if not n:
        return table.sparkSession.createDataFrame([], schema)
    model = fit(rows.select(column), n, d, components)
    k = min(components, d)
    explained = model.eigenvalues / model.trace if model.trace else np.full(k, np.nan)

    def run(batches):
        for part, x in _steps(batches, len(carried), d):
            m = part.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            arrays = [part.column(i).take(each) for i in range(len(carried))]
            arrays += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviations(x, model.sums, n).take(each)]
            values = (model.scores(x) if model.factors else np.full((m, k), np.nan)).ravel()
            arrays += [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (values, np.tile(explained, m))]
            arrays.append(pa.array([model.identity_error] * (m * k), pa.float64()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.select(*carried, column).transform(common.in_tasks, run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
