"""Quality classifier: support vectors on naive Bayes scaled n-gram indicators.

Tokens are runs of letters, of digits and of other characters; letters are folded to
lower case.  A token equal to the one before it is replaced by a mark of its own, and a
run of capitals adds one, so that patterns of words not seen in training count as well.
Indicators of the token n-grams in ``ORDERS`` are hashed to ``DIMS`` places, scaled by
the class log-count ratio, and a linear model with hinge loss is fitted on a bounded,
hash-drawn sample (``PER_CLASS``) by dual coordinate descent.  Margins become scores by
a logistic curve fitted on rows kept from training.

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

ORDERS = (1, 2, 3)
BITS = 20
DIMS = 1 << BITS
PER_CLASS = {1: 5000, 0: 5000}
THRESHOLD = 0.3

_KIND = np.full(256, 3, np.uint8)  # other characters
_KIND[grams.SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
_SAME, _CAPS = np.uint64(0x5A3E), np.uint64(0xCA95)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and the texts' n+1 first positions among them."""
    kind = _KIND[buf]
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[off[:-1][off[:-1] < len(buf)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(buf))[:len(start)]
    word = kind[start] > 0
    start, end = start[word], end[word]
    first = np.searchsorted(start, off)
    h = grams.Hashed(grams.LOWER[buf]).of(start, end)
    capitals = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_CAPITAL[buf], out=capitals[1:])
    shouted = (capitals[end] - capitals[start] == end - start) & (end - start > 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (kind[start[1:]] == 1)
    same[first[:-1][first[:-1] < len(h)]] = False
    return np.where(same, _SAME, np.where(shouted, _CAPS, h)), first


def ngrams(buf: np.ndarray, off: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the token n-grams, each pair once."""
    h, first = tokens(buf, off)
    pairs = []
    for n in ORDERS:
        _, own, g = grams.windows(h, first, n)
        feature = (grams.mix(g + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
        if mask is not None:
            own, feature = own[mask[feature]], feature[mask[feature]]
        pairs.append(own << BITS | feature)
    pair = np.unique(np.concatenate(pairs))
    return pair >> BITS, pair & (DIMS - 1)


def extract(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    own, feature = ngrams(buf, off)
    return np.split(feature.astype(np.int32), np.searchsorted(own, np.arange(1, len(off) - 1)))


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, cost: float = 0.1,
        min_rows: int = 3, epochs: int = 40, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss, rows in an order drawn from a fixed seed."""
    ratio, df = linear.log_count_ratio(rows, y, DIMS)
    use = (df >= min_rows) & (np.abs(ratio) > 0.1)
    place = np.cumsum(use) - 1
    cols = [place[x[use[x]]] for x in rows]
    scale = np.append(ratio[use], 1.0)  # the last is the bias
    xs = [(np.append(c, len(scale) - 1), scale[np.append(c, len(scale) - 1)]) for c in cols]
    square = np.array([(v * v).sum() for _, v in xs])
    sign = np.where(y == 1, 1.0, -1.0)
    upper = cost * weight / weight.mean()
    w, alpha = np.zeros(len(scale)), np.zeros(len(y))
    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(y)):
            c, v = xs[i]
            g = sign[i] * (w[c] @ v) - 1
            projected = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == upper[i] else g
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - g / square[i], 0.0), upper[i])
                w[c] += (new - alpha[i]) * sign[i] * v
                alpha[i] = new
        if worst < tolerance:
            break
    value = w[:-1] * scale[:-1]
    kept = np.abs(value) > 1e-6
    return np.flatnonzero(use)[kept], value[kept], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, fold, label: str = "quality", per_class: dict[int, int] | None = None) -> dict:
    sample = linear.labelled_sample(docs, labels, label, fold, per_class or PER_CLASS)
    return linear.fit_once(sample, extract, fit)


def quality(docs: DataFrame, model: dict, text: bool = False) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, and with the text only if ``text``."""
    return linear.score(docs.drop("predicted"), model, DIMS, ngrams, text).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = common.id_remainder("doc_id", 5) == 0
    scored = quality(docs, train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
