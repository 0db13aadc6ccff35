"""Link functions and reporting helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def inv_logit(eta) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(eta)))


def inv_cloglog(eta) -> Column:
    """1 − exp(−exp(η))."""
    return F.lit(1.0) - F.exp(-F.exp(_c(eta)))


def odds(p) -> Column:
    p = _c(p)
    return p / (F.lit(1.0) - p)


def format_p(p, digits: int = 3) -> Column:
    """P25: '<0.001' below 0.001, else the p-value rounded to ``digits`` as text."""
    p = _c(p)
    return F.when(p < 0.001, F.lit("<0.001")).otherwise(F.round(p, digits).cast("string"))
