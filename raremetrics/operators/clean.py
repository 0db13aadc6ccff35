"""Row filters and data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the reference's cleaning rules.
MIN_EFFORT_HOURS = 10.0 / 60.0   # keep shots trawling for at least 10 minutes
MAX_EFFORT_HOURS = 7.0           # model data keeps shots of at most 7 h
MAX_DEPTH = 200.0                # depth outliers at or beyond 200 m are dropped
MIN_YEARS_EXCLUSIVE = 5          # vessels need more than 5 distinct years
MAX_FACTOR_LEVELS = 32
# Shot ids excluded as wrong total catch, and as combined shots with wrong hours.
WRONG_TOTAL_CATCH_IDS = [154222, 125202, 120177, 154921, 154109, 134415]
WRONG_HOURS_COMBINED_IDS = [124582, 124583, 124584, 124585, 118776, 118777, 118778, 118779, 118780,
                            118781, 118782, 118783, 113895, 113896, 113897, 118785, 118786, 118787,
                            118788, 118789, 118790, 118791, 150522, 124586, 124587, 124588, 124589]


def year_window(df: DataFrame, yr: str = "yr", after: int = 2005, up_to: int = 2020) -> DataFrame:
    """keep after < yr <= up_to."""
    return df.filter((F.col(yr) > after) & (F.col(yr) <= up_to))


def excluded_shots(spark: SparkSession) -> DataFrame:
    """The reference log's own exclusion table (shot_id, reason), for ``exclude_ids``."""
    rows = [(i, "wrong total catch") for i in WRONG_TOTAL_CATCH_IDS] + [
        (i, "combined shots with wrong hours") for i in WRONG_HOURS_COMBINED_IDS]
    return spark.createDataFrame(rows, "shot_id long, reason string")


def exclude_ids(df: DataFrame, id_col: str, rules: DataFrame) -> DataFrame:
    """drop the ids in the first column of ``rules``; a null id is kept (R ``!x %in% v`` is TRUE for NA).

    A left-anti join: the planner broadcasts the rules when small at runtime, otherwise shuffles.
    """
    ids = rules.select(F.col(rules.columns[0]).alias("__excl_id")).dropna().distinct()
    return df.join(ids, F.col(id_col) == F.col("__excl_id"), "left_anti")


def min_effort(df: DataFrame, hours: str = "hrs", minimum: float = MIN_EFFORT_HOURS) -> DataFrame:
    """effort at least ``minimum`` hours (null effort dropped)."""
    return df.filter(F.col(hours) >= F.lit(minimum))


def known_vessel(df: DataFrame, vessel: str = "vessel") -> DataFrame:
    """drop blank vessel names (null names drop too, as NA predicates do)."""
    return df.filter(F.col(vessel) != F.lit(""))


def max_effort(df: DataFrame, hours: str = "hrs", maximum: float = MAX_EFFORT_HOURS) -> DataFrame:
    """effort at most ``maximum`` hours."""
    return df.filter(F.col(hours) <= F.lit(maximum))


def effort_audit(df: DataFrame, hours: str = "hrs", maximum: float = MAX_EFFORT_HOURS,
                 counts: list[str] | None = None) -> DataFrame:
    """F5 audit: shots and catch above vs within the effort cap, one global aggregate."""
    counts = counts or ["narrow", "green"]
    over = F.col(hours) > F.lit(maximum)
    return (df.filter(F.col(hours).isNotNull())
            .groupBy(over.alias("over_cap"))
            .agg(F.count(F.lit(1)).alias("shots"),
                 *[F.sum(c).cast("bigint").alias(f"{c}_total") for c in counts]))


def bbox(df: DataFrame, lat: str, lon: str, lat_range=(-21.0, -17.0), lon_range=(114.0, 121.0)) -> DataFrame:
    """strict bounding box."""
    return df.filter((F.col(lat) > lat_range[0]) & (F.col(lat) < lat_range[1])
                     & (F.col(lon) < lon_range[1]) & (F.col(lon) > lon_range[0]))


def depth_cut(df: DataFrame, depth: str = "depth", maximum: float = MAX_DEPTH) -> DataFrame:
    """drop depth outliers (and missing depth)."""
    return df.filter(F.col(depth) < F.lit(maximum))


def positive(df: DataFrame, count: str) -> DataFrame:
    """F8: shots with a positive count."""
    return df.filter(F.col(count) > 0)


def rate_band(df: DataFrame, rate: str, low: float = 0.0, high: float = 3.0) -> DataFrame:
    """F8: shots whose rate lies strictly between the bounds."""
    return df.filter((F.col(rate) > F.lit(float(low))) & (F.col(rate) < F.lit(float(high))))


def vessel_tenure(df: DataFrame, vessel: str = "vessel", yr: str = "yr",
                  min_years_exclusive: int = MIN_YEARS_EXCLUSIVE) -> DataFrame:
    """keep rows of vessels with records in more than ``min_years_exclusive`` years.

    Distinct (vessel, year) pairs are de-duplicated map-side before the shuffle,
    so a vessel holding most rows does not concentrate raw rows in one task; the
    qualifying-vessel list is then semi-joined back (AQE broadcasts it when small
    and splits skewed partitions otherwise).
    """
    keep = (df.select(vessel, yr).dropna().distinct()
            .groupBy(vessel).agg(F.count(F.lit(1)).alias("__years"))
            .filter(F.col("__years") > min_years_exclusive).select(vessel))
    return df.join(keep, on=vessel, how="left_semi")


def vessel_years(df: DataFrame, vessel: str = "vessel", yr: str = "yr") -> DataFrame:
    """Vessel × year presence (1 when the vessel has any record in the year), long form."""
    return df.select(vessel, yr).dropna().distinct().withColumn("present", F.lit(1))


def cap_to_positive_max(df: DataFrame, hours: str, count: str) -> DataFrame:
    """effort at most the largest effort of any positive shot (scalar subquery)."""
    cap = df.filter(F.col(count) > 0).agg(F.max(hours).alias("__cap"))
    # one-row side: broadcast is bounded by construction
    return df.crossJoin(F.broadcast(cap)).filter(F.col(hours) <= F.col("__cap")).drop("__cap")


def range_audit(df: DataFrame, id_col: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """one long table of rule violations (id, column, value) for out-of-range parts."""
    cols = list(bounds)
    long = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [id_col], cols, "column", "value")
    cond = F.lit(False)
    for c, (lo, hi) in bounds.items():
        cond = cond | ((F.col("column") == c) & ((F.col("value") < lo) | (F.col("value") > hi)))
    return long.filter(cond)


def level_audit(df: DataFrame, columns: list[str], max_levels: int = MAX_FACTOR_LEVELS) -> DataFrame:
    """distinct non-null levels per factor column and whether it exceeds ``max_levels``."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column", "level")
    return (long.dropna().distinct().groupBy("column")
            .agg(F.count(F.lit(1)).alias("n_levels"))
            .withColumn("too_many", F.col("n_levels") > max_levels))
