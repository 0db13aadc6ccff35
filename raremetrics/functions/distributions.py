"""Tail probabilities used in reports (χ², normal), vectorised over Arrow batches.

The regularised upper incomplete gamma Q(a, x) is evaluated with the series for
x < a + 1 and Lentz's continued fraction otherwise (Numerical Recipes §6.2).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gammaq(a: float, x: float) -> float:
    if x is None or a is None or not np.isfinite(x) or a <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b = x + 1.0 - a
    c = 1.0 / 1e-300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf_scalar(stat: float, dof: float) -> float:
    return _gammaq(dof / 2.0, stat / 2.0)


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the χ² distribution, P(X > stat)."""
    return pd.Series([chi2_sf_scalar(float(s), float(d)) if pd.notna(s) and pd.notna(d) else None
                      for s, d in zip(stat, dof)], dtype="float64")


def norm_sf_scalar(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))
