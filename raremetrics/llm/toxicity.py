"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are indicators of the n-grams of characters (code points; ASCII letters are
folded to lower case) of the orders in ``ORDERS``, hashed to ``DIMS`` places.  Each is
scaled by its log-count ratio between toxic and other training texts; a logistic model
with an L2 penalty is fitted on the scaled indicators of a bounded, hash-drawn sample
(``per_class``) and calibrated on margins of models that have not seen the row
(``FOLDS``).  Scoring reads every whole text: one pass of vectorised hashing without any
join or shuffle.

Defined cases: a null or empty text has no features and gets the score of the bias
alone; equal texts get equal scores; ids that repeat keep all their rows; labels that
contradict each other are not used; without labels of both classes every score is the
share of label 1; extra columns are carried along (``score`` and ``predicted`` are
replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raremetrics.llm import common, grams, linear

ORDERS = (4, 5, 6)
BITS = 20
DIMS = 1 << BITS
PER_CLASS = {1: 2500, 0: 5000}
THRESHOLD = 0.3
FOLDS = 5


def ngrams(buf: np.ndarray, off: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the character n-grams, each pair once."""
    hashed = grams.Hashed(grams.LOWER[buf])
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    first = np.searchsorted(start, off)
    edge = np.append(start, len(buf))
    last = np.repeat(first[1:], np.diff(first))  # end of each character's text, in characters
    texts, features = [], []
    for n in ORDERS:
        at = np.flatnonzero(np.arange(len(start)) + n <= last)
        feature = (hashed.of(edge[at], edge[at + n]) >> np.uint64(64 - BITS)).astype(np.int64)
        if mask is not None:
            use = mask[feature]
            at, feature = at[use], feature[use]
        features.append(feature)
        texts.append(np.searchsorted(first, at, "right") - 1 if mask is not None else grams.owner(first)[at])
    pair = np.unique(np.concatenate(texts) << BITS | np.concatenate(features))
    return pair >> BITS, pair & (DIMS - 1)


def extract(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    own, feature = ngrams(buf, off)
    return np.split(feature.astype(np.int32), np.searchsorted(own, np.arange(1, len(off) - 1)))


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, penalty: float = 0.3,
        min_rows: int = 3, min_z: float = 4.0, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the n-grams: logistic loss on ratio-scaled indicators, accelerated gradient steps."""
    ratio, df = linear.log_count_ratio(rows, y, DIMS)
    share = y.mean()
    hits = np.zeros(DIMS)
    for x, label in zip(rows, y, strict=True):
        hits[x] += label
    z = (hits - df * share) / np.sqrt(np.maximum(df * share * (1 - share), 1e-9))
    use = (df >= min_rows) & (np.abs(z) >= min_z)
    place = np.cumsum(use) - 1
    own = np.concatenate([np.full(use[x].sum(), i) for i, x in enumerate(rows)])
    col = np.concatenate([place[x[use[x]]] for x in rows])
    scale = ratio[use]
    w, b = np.zeros(len(scale)), 0.0
    weight = weight / weight.mean()
    # the largest curvature, by power iteration, gives the step
    u = np.ones(len(scale) + 1)
    for _ in range(15):
        z = np.bincount(own, (u[:-1] * scale)[col], minlength=len(y)) + u[-1]
        u = np.append(np.bincount(col, (weight * z)[own], minlength=len(scale)) * scale, (weight * z).sum())
        norm = np.linalg.norm(u)
        u /= max(norm, 1e-12)
    step = 1 / (norm / 4 + penalty)
    vw, vb = w.copy(), b
    for t in range(steps):
        p = linear.sigmoid(np.bincount(own, (vw * scale)[col], minlength=len(y)) + vb)
        g = weight * (p - y)
        nw = vw - step * (np.bincount(col, g[own], minlength=len(scale)) * scale + penalty * vw)
        nb = vb - step * g.sum()
        m = t / (t + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    value = w * scale
    kept = np.abs(value) >= 0.01
    return np.flatnonzero(use)[kept], value[kept], float(b)


def train(docs: DataFrame, labels: DataFrame, fold, label: str = "toxic", per_class: dict[int, int] | None = None) -> dict:
    sample = linear.labelled_sample(docs, labels, label, fold, per_class or PER_CLASS)
    return linear.fit_once(sample, extract, fit, FOLDS)


def toxicity(docs: DataFrame, model: dict, text: bool = False) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, and with the text only if ``text``."""
    return linear.score(docs.drop("predicted"), model, DIMS, ngrams, text).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = common.id_remainder("doc_id", 4) == 2
    scored = toxicity(docs, train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
