"""Effort bins and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N

BIN_WIDTH_HOURS = 0.5  # fixed: 30-minute effort bins (the way fishers operate)


def effort_bins(df: DataFrame, hours: str = "hrs", catch_cols: list[str] | None = None,
                width: float = BIN_WIDTH_HOURS) -> DataFrame:
    """Shots and interactions per 30-min effort bin, zero-filled, with proportions.

    Effort is first capped at the largest effort of any positive shot (F10); bins run
    (0, w], (w, 2w], ... up to round(max effort) (T16). One aggregate gives both series:
    a bin exists when it has shots, and its interactions sum to 0 when none were
    positive, which is the reference's anti-join zero fill (T23).
    """
    catch_cols = catch_cols or ["narrow", "green"]
    pos = F.lit(0)
    for c in catch_cols:
        pos = pos + F.col(c)
    d = df.select(F.col(hours).alias("__h"), pos.alias("__pos"))
    cap = d.agg(F.max(F.when(F.col("__pos") > 0, F.col("__h"))).alias("__cap"))
    d = d.crossJoin(F.broadcast(cap)).filter(F.col("__h") <= F.col("__cap"))
    upper = F.bround(F.col("__cap"), 0)
    b = F.when((F.col("__h") > 0) & (F.col("__h") <= upper), F.ceil(F.col("__h") / F.lit(width)).cast("int"))
    g = (d.select(b.alias("bin"), "__pos").filter(F.col("bin").isNotNull()).groupBy("bin")
         .agg(F.count(F.lit(1)).alias("shots"),
              F.sum(F.when(F.col("__pos") > 0, F.col("__pos")).otherwise(F.lit(0))).cast("bigint").alias("interactions")))
    return g.withColumns({"bin_mid": N.bin_mid("bin", width),
                          "prop_positive": F.col("interactions") / F.col("shots")})


def histogram(df: DataFrame, value: str, width: float, origin: float = 0.0) -> DataFrame:
    """Fixed-width histogram counts, bins [origin+k·w, origin+(k+1)·w)."""
    k = F.floor((F.col(value) - F.lit(origin)) / F.lit(width)).cast("bigint")
    return (df.select(k.alias("bin")).dropna().groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
            .withColumns({"lo": F.lit(origin) + F.col("bin") * F.lit(width),
                          "hi": F.lit(origin) + (F.col("bin") + 1) * F.lit(width)}))


def equal_width_cut(df: DataFrame, value: str, n: int = 10, out: str = "bin") -> DataFrame:
    """Assign ``n`` equal-width right-closed bins over the column's range."""
    rng = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return (df.crossJoin(F.broadcast(rng))
            .withColumn(out, N.cut_equal_width(value, F.col("__lo"), F.col("__hi"), n))
            .drop("__lo", "__hi"))


def inverse_frequency_weights(df: DataFrame, bin_col: str, out: str = "weight") -> DataFrame:
    """Weight 1/(rows in the row's bin), via a per-bin count joined back.

    The count table has one row per bin; the join lets AQE broadcast it, so a bin
    holding most rows never lands in one task (unlike a window over the bin)."""
    cnt = df.groupBy(bin_col).agg(F.count(F.lit(1)).alias("__cnt"))
    return (df.join(cnt, on=bin_col, how="left")
            .withColumn(out, F.lit(1.0) / F.col("__cnt")).drop("__cnt"))


def zero_fill(levels: DataFrame, counts: DataFrame, key: str, value: str) -> DataFrame:
    """Every level of ``levels`` with its count, 0 where absent."""
    return (levels.select(key).distinct().join(counts, on=key, how="left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(0))))


def add_ratio(df: DataFrame, num: str, den: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(num) / F.col(den))

