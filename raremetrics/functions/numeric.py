"""Numeric column rules whose R semantics differ from Spark defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mean_ignoring_null(a, b) -> Column:
    """Mean of two values ignoring a null one; both null → null."""
    a, b = _c(a), _c(b)
    return (F.when(a.isNull(), b)
            .when(b.isNull(), a)
            .otherwise((a + b) / F.lit(2.0)))


def round_to(c, width: float) -> Column:
    """``width * round(x / width)`` with half-to-even rounding."""
    return F.lit(float(width)) * F.bround(_c(c) / F.lit(float(width)), 0)


def trunc_tenth(c, parity: bool = True) -> Column:
    """Truncate a coordinate toward zero to 0.1 degree.

    ``parity=True`` keeps the first five characters of the text form (valid for
    two-digit south latitudes and three-digit longitudes, as in the log);
    otherwise the arithmetic form ``sign(x)*floor(|x|*10)/10`` is used.
    """
    x = _c(c)
    if parity:
        return F.substring(x.cast("string"), 1, 5).cast("double")
    return F.signum(x) * F.floor(F.abs(x) * F.lit(10.0)) / F.lit(10.0)


def cell_centre_lat(cell_lat) -> Column:
    """Cell centre latitude: half a cell toward the equator-opposite side (lat − 0.05)."""
    return _c(cell_lat) - F.lit(0.05)


def cell_centre_lon(cell_lon) -> Column:
    return _c(cell_lon) + F.lit(0.05)


def cut_equal_width(c, lo, hi, n: int) -> Column:
    """Bin 1..n of ``n`` equal right-closed bins spanning [lo, hi].

    ``lo``/``hi`` are columns or literals (typically a broadcast one-row min/max).
    The lowest value falls in bin 1 as with R's widened outer break.
    """
    x, lo, hi = _c(c), _c(lo) if not isinstance(lo, (int, float)) else F.lit(float(lo)), \
        _c(hi) if not isinstance(hi, (int, float)) else F.lit(float(hi))
    width = (hi - lo) / F.lit(float(n))
    raw = F.ceil((x - lo) / width)
    return F.when(width == 0, F.lit(1)).otherwise(F.least(F.lit(n), F.greatest(F.lit(1), raw))).cast("int")


def cut_fixed_width(c, width: float, upper: float) -> Column:
    """Bins (0,w], (w,2w], ... up to ``upper``; 0 and > upper → null."""
    x = _c(c)
    return F.when((x > 0) & (x <= F.lit(float(upper))),
                  F.ceil(x / F.lit(float(width))).cast("int"))


def bin_mid(bin_col, width: float) -> Column:
    """Midpoint of fixed-width bin ``k`` = (k − 0.5)·w."""
    return (_c(bin_col).cast("double") - F.lit(0.5)) * F.lit(float(width))
