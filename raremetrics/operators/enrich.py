"""Joins of covariate tables onto shots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clean


def climatology(sst: DataFrame, by: list[str] | tuple = ("mn",), value: str = "value",
                lat: str = "lat", lon: str = "lon", box: bool = True) -> DataFrame:
    """A2: mean temperature by the ``by`` keys (month climatology by default) inside the box.

    Rows with a null in any formula variable are dropped first (T3).
    """
    df = clean.bbox(sst, lat, lon) if box else sst
    by = list(by)
    return df.dropna(subset=by + [value]).groupBy(*by).agg(F.avg(value).alias("temperature"))


def with_climatology(shots: DataFrame, clim: DataFrame, month: str = "mn", clim_month: str = "mn") -> DataFrame:
    """Left join the month climatology (≤ 12 rows: broadcast is bounded by the calendar)."""
    c = clim.withColumnRenamed(clim_month, "__clim_mn")
    return (shots.join(F.broadcast(c), F.col(month).eqNullSafe(F.col("__clim_mn")), "left")
            .drop("__clim_mn"))


def annual_totals(df: DataFrame, yr: str = "yr", measures: list[str] | None = None) -> DataFrame:
    """A3: sums per year after dropping rows with a null in any measure."""
    measures = measures or ["green", "narrow", "hrs"]
    return (df.dropna(subset=[yr] + measures).groupBy(yr)
            .agg(*[F.sum(m).alias(m) for m in measures]))


def with_annual_effort(shots: DataFrame, yr: str = "yr", hours: str = "hrs",
                       measures: list[str] | None = None) -> DataFrame:
    """Inner join of annual effort (hours summed per year) onto shots.

    The yearly table has one row per calendar year, so broadcasting it is bounded.
    Years with no complete row drop out, as in an inner merge.
    """
    ann = annual_totals(shots, yr, measures or ["green", "narrow", hours]).select(
        F.col(yr).alias("__ann_yr"), F.col(hours).alias("ann_eff"))
    return shots.join(F.broadcast(ann), F.col(yr) == F.col("__ann_yr"), "inner").drop("__ann_yr")


def join_imputed(shots: DataFrame, imputed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Null-safe left join of imputed values on a composite key."""
    right = imputed.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col(value).alias(f"__r_{value}"))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    out = shots.join(right, cond, "left")
    return out.drop(*[f"__r_{k}" for k in keys]).withColumnRenamed(f"__r_{value}", value)
