"""Shared parts of the text classifiers: labelled samples, log-count ratios, calibration."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raremetrics.llm import common


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: dict[int, int]) -> DataFrame:
    """(doc_id, text, label, weight) of about ``per_class`` labelled rows of each class.

    A row is taken if the hash of its id lies below its class's rate, so the sample is
    the same on every run; ``weight`` undoes the rate.  Rows outside ``fold``, without a
    label, or with contradicting labels of one id are not used.
    """
    known = (labels.filter(fold & F.col(label).isin(*per_class)).groupBy("doc_id")
             .agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other").drop("other"))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = {c: min(1.0, n / max(total.get(c, 0), 1)) for c, n in per_class.items()}
    of = F.create_map(*[F.lit(x) for c, r in rate.items() for x in (c, float(r))])[F.col("label")]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.withColumn("rate", of).filter(draw < F.col("rate"))
    # at most the sum of per_class rows in expectation, whatever the input: safe to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", F.col("label").cast("int").alias("label"), (1 / F.col("rate")).alias("weight"))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, dims: int, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratios of indicator features, and in how many rows each occurs."""
    count = [np.full(dims, alpha) for _ in range(2)]
    for x, label in zip(rows, y, strict=True):
        count[label][x] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    return ratio, count[0] + count[1] - 2 * alpha


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from margins to probabilities, by Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * margin + b)
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * margin).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()],
                         [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


MODEL = pa.schema([("feature", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())),
                   ("bias", pa.float64()), ("slope", pa.float64()), ("offset", pa.float64())])


def margins(model: tuple[np.ndarray, np.ndarray, float], rows: list[np.ndarray]) -> np.ndarray:
    """Weighted sums of the features of ``rows``, with the bias."""
    feature, value, bias = model
    weights = dict(zip(feature.tolist(), value.tolist(), strict=True))
    return np.array([sum(weights.get(f, 0.0) for f in x.tolist()) for x in rows]) + bias


def cross_fitted(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, fit, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their margins by a model that has not seen them; rows with equal features share a fold.

    Rows whose fold leaves no training rows of both classes have no margin.
    """
    fold = np.array([zlib.crc32(x.tobytes()) % folds for x in rows])
    margin = np.full(len(rows), np.nan)
    for k in range(folds):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own) and len({*y[rest]}) == 2:
            margin[own] = margins(fit([rows[i] for i in rest], y[rest], weight[rest]), [rows[i] for i in own])
    known = np.flatnonzero(~np.isnan(margin))
    return known, margin[known]


def fit_once(sample: DataFrame, extract, fit, folds: int | None = None) -> dict:
    """Train in one task on the bounded sample; the model (sparse weights) comes to the driver.

    ``extract(buf, off)`` gives the features of each text; ``fit(rows, y, weight)``
    the features with a weight, the weights and the bias.  With ``folds`` the model is
    fitted to all rows and calibrated on margins by models without the row's fold;
    else a fifth of the rows, by the id's hash, is kept from training and used for
    calibration.  Without rows of both classes the score is the share of class 1 (0
    without any row).
    """

    def run(batches):
        found = []
        for batch in batches:
            ids, y, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            for lo, hi, buf, off in common.text_chunks(batch):
                found += zip(ids[lo:hi], extract(buf, off), y[lo:hi], weight[lo:hi], strict=True)
        found.sort(key=lambda x: (x[0], len(x[1])))
        y = np.array([x[2] for x in found], np.int64)
        weight = np.array([x[3] for x in found])
        rows = [x[1] for x in found]
        held = np.array([folds is None and int(x[0]) * 0x9E3779B1 % 2**32 % 5 == 0 for x in found], bool)
        if min((y[~held] == c).sum() for c in (0, 1)) == 0:
            share = (weight * y).sum() / weight.sum() if len(y) else 0.0
            feature, value, bias, slope, offset = [], [], 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        else:
            model = feature, value, bias = fit([r for r, h in zip(rows, held, strict=True) if not h], y[~held], weight[~held])
            use, margin = (np.flatnonzero(held), None) if folds is None else cross_fitted(rows, y, weight, fit, folds)
            if len({*y[use]}) < 2:
                use, margin = np.arange(len(y)), None
            if margin is None:
                margin = margins(model, [rows[i] for i in use])
            slope, offset = platt(margin, y[use], weight[use] / weight[use].mean())
        yield pa.RecordBatch.from_pylist([{"feature": list(feature), "value": list(value), "bias": bias,
                                           "slope": slope, "offset": offset}], schema=MODEL)

    from pyspark.sql.pandas.types import from_arrow_schema

    found = sample.repartition(1).transform(common.in_tasks, run, from_arrow_schema(MODEL)).first()
    if found is None:  # no partition at all
        return {"feature": np.zeros(0, np.int64), "value": np.zeros(0), "bias": 0.0, "slope": 0.0, "offset": float(np.log(1e-9))}
    return {"feature": np.array(found["feature"], np.int64), "value": np.array(found["value"]),
            "bias": found["bias"], "slope": found["slope"], "offset": found["offset"]}


def score(docs: DataFrame, model: dict, dims: int, present, text: bool = False) -> DataFrame:
    """``docs`` with ``score``, and with the text only if ``text``.

    ``present(buf, off, mask)`` gives (text number, feature) pairs, each pair once, of
    the features set in ``mask``.
    """
    carried = [c for c in docs.columns if c != "score" and (text or c != "text")]
    schema = docs.select(*carried).schema.add("score", "double")

    def run(batches):
        table = np.zeros(dims)
        table[model["feature"]] = model["value"]
        mask = table != 0
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch):
                own, feature = present(buf, off, mask)
                margin = np.bincount(own, table[feature], minlength=hi - lo) + model["bias"]
                arrays = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carried]
                arrays.append(pa.array(sigmoid(model["slope"] * margin + model["offset"])))
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, "score"])

    return docs.select(*carried, *([] if text else ["text"])).transform(common.in_tasks, run, schema)
