"""Linear discriminant analysis (G13) and a radial-kernel SVM by random Fourier
features (G14), both as aggregates plus column expressions.

LDA needs per class only n, Σx and Σxxᵀ: one grouped aggregate; the pooled
covariance, discriminant direction and threshold are p×p algebra on the driver,
and scoring is a JVM-side linear expression.

The radial SVM maps inputs to D random cosine features z_k = √(2/D)·cos(w_kᵀx + b_k)
with w_k ~ N(0, 2γ·I), b_k ~ U(0, 2π) (Rahimi & Recht 2007) — inner products of z
approximate the Gaussian kernel exp(−γ‖x−x'‖²) — and fits MLlib's LinearSVC on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class LdaFit:
    features: list
    means: dict
    priors: dict
    cov: np.ndarray
    coef: np.ndarray
    intercept: float

    def score(self, df: DataFrame, out: str = "lda_score") -> DataFrame:
        """Log-odds of class 1 vs class 0 as a column expression."""
        e = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.coef):
            e = e + F.lit(float(w)) * F.col(c)
        return df.withColumn(out, e)


def fit_lda(df: DataFrame, label: str, features: list[str]) -> LdaFit:
    """Two-class LDA with class priors from the data."""
    p = len(features)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"s_{i}") for i, c in enumerate(features)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"q_{i}_{j}") for i, a in enumerate(features)
             for j, b in enumerate(features) if j >= i]
    rows = df.select(label, *features).dropna().groupBy(label).agg(*aggs).collect()
    stats = {}
    for r in rows:
        n = r["n"]
        s = np.array([r[f"s_{i}"] for i in range(p)], dtype=float)
        q = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                q[i, j] = q[j, i] = r[f"q_{i}_{j}"]
        stats[r[label]] = (n, s, q)
    ntot = sum(v[0] for v in stats.values())
    scatter = sum(q - np.outer(s, s) / n for n, s, q in stats.values())
    cov = scatter / (ntot - len(stats))
    means = {k: s / n for k, (n, s, q) in stats.items()}
    priors = {k: n / ntot for k, (n, s, q) in stats.items()}
    k1, k0 = max(stats), min(stats)
    ci = np.linalg.pinv(cov)
    coef = ci @ (means[k1] - means[k0])
    intercept = float(-0.5 * (means[k1] @ ci @ means[k1] - means[k0] @ ci @ means[k0])
                      + np.log(priors[k1] / priors[k0]))
    return LdaFit(features, means, priors, cov, coef, intercept)


def random_fourier_features(df: DataFrame, features: list[str], n_features: int = 100, gamma: float = 1.0,
                            seed: int = 666, out: str = "features") -> DataFrame:
    """D cosine features as one vector column, computed per Arrow batch as a numpy
    matrix product (inputs should be scaled first). Rows with a null input are dropped."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import types as T
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2.0 * gamma), (n_features, len(features)))
    b = rng.uniform(0.0, 2.0 * np.pi, n_features)
    scale = np.sqrt(2.0 / n_features)
    d = df.dropna(subset=features)
    schema = T.StructType(d.schema.fields + [T.StructField("__rff", T.ArrayType(T.DoubleType()))])

    def fn(it):
        for pdf in it:
            X = pdf[features].to_numpy(dtype=float)
            Z = scale * np.cos(X @ W.T + b)
            yield pdf.assign(__rff=list(Z))
    return d.mapInPandas(fn, schema).withColumn(out, array_to_vector("__rff")).drop("__rff")


def fit_rbf_svm(df: DataFrame, label: str, features: list[str], n_features: int = 100, gamma: float = 1.0,
                reg: float = 0.01, seed: int = 666):
    """Approximate radial SVM = LinearSVC on random Fourier features.
    Returns (model, transform) where transform(df) adds the 'features' vector."""
    def transform(d: DataFrame) -> DataFrame:
        return random_fourier_features(d, features, n_features, gamma, seed, "features")
    model = LinearSVC(labelCol=label, featuresCol="features", regParam=reg, maxIter=100).fit(transform(df))
    return model, transform


def discriminant_scores(train: DataFrame, test: DataFrame, label: str, features: str) -> dict[str, DataFrame]:
    """G13 and G14 fitted to ``train``, with ``score`` (positive for class 1) and ``prediction`` of ``test``, by name.

    ``features`` is a vector column; its columns are centred and scaled by the training rows (a constant one becomes 0)."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    scaler = StandardScaler(withMean=True, withStd=True, inputCol=features, outputCol="__scaled").fit(train)
    cols = [f"__x{i}" for i in range(len(scaler.mean))]

    def scaled(df: DataFrame) -> DataFrame:
        wide = scaler.transform(df).select(label, vector_to_array("__scaled").alias("__x"))
        return wide.select(label, *[F.col("__x")[i].alias(c) for i, c in enumerate(cols)])

    train, test = scaled(train).checkpoint(eager=True), scaled(test).checkpoint(eager=True)
    lda = fit_lda(train, label, cols).score(test, "score")
    svm, transform = fit_rbf_svm(train, label, cols, 100, 0.5)
    radial = svm.transform(transform(test)).withColumn("score", vector_to_array("rawPrediction")[1])
    return {"lda": lda.withColumn("prediction", (F.col("score") > 0).cast("double")).select(label, "score", "prediction"),
            "svm_radial": radial.select(label, "score", "prediction")}
