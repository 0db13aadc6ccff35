"""Derived columns of the shot log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import dates as D
from ..functions import numeric as N

# The two species and their alive/dead count columns (canonical names).
SPECIES = {"narrow": ("narrow_alive", "narrow_dead"), "green": ("green_alive", "green_dead")}
# Recodes applied to the raw log.
LFB_RECODE = {"f550": "F550"}
VESSEL_ALIASES = {"torbay ii": "torbay"}


def standardise_log(raw: DataFrame) -> DataFrame:
    """P1-P6 on the raw shot-log CSV (S1): parse, derive parts and effort, totals, midpoints.

    Output uses the canonical snake_case columns used throughout the library.
    """
    start_ts = D.combine_datetime("StartDate", "StartTime")
    end_ts = D.combine_datetime("EndDate", "EndTime")
    df = raw.select(
        F.col("HC").alias("shot_id"), F.col("VESSEL").alias("vessel"), F.col("LFB").alias("lfb"),
        D.parse_date("UNLOAD").alias("unload"),
        D.parse_date("StartDate").alias("start_date"), D.parse_date("EndDate").alias("end_date"),
        start_ts.alias("start_ts"), end_ts.alias("end_ts"),
        F.col("SLAT").alias("slat"), F.col("ELAT").alias("elat"),
        F.col("SLONG").alias("slong"), F.col("ELONG").alias("elong"),
        F.col("SDEPTH").alias("sdepth"), F.col("EDEPTH").alias("edepth"),
        F.col("AREA").alias("area"),
        F.col("SawfishNarrowALIVE").alias("narrow_alive"), F.col("SawfishNarrowDEAD").alias("narrow_dead"),
        F.col("SawfishGreenALIVE").alias("green_alive"), F.col("SawfishGreenDEAD").alias("green_dead"),
        F.col("TotalCatch").alias("total_catch"),
    )
    df = df.select(
        "*",
        F.year("start_date").cast("int").alias("yr"), F.month("start_date").cast("int").alias("mn"),
        F.dayofmonth("start_date").cast("int").alias("dy"),
        F.year("end_date").cast("int").alias("end_yr"), F.month("end_date").cast("int").alias("end_mn"),
        F.dayofmonth("end_date").cast("int").alias("end_dy"),
        F.year("unload").cast("int").alias("unload_yr"), F.month("unload").cast("int").alias("unload_mn"),
        F.dayofmonth("unload").cast("int").alias("unload_dy"),
        F.hour("start_ts").cast("int").alias("start_hour"), F.hour("end_ts").cast("int").alias("end_hour"),
        D.hours_between("start_ts", "end_ts").alias("hrs"),
    )
    return with_midpoints(with_totals(df))


def with_totals(df: DataFrame, species: dict | None = None) -> DataFrame:
    """P5: null counts → 0 and total = alive + dead per species."""
    species = species or SPECIES
    cols = {}
    for name, (alive, dead) in species.items():
        a = F.coalesce(F.col(alive), F.lit(0)).cast("bigint")
        d = F.coalesce(F.col(dead), F.lit(0)).cast("bigint")
        cols[alive], cols[dead], cols[name] = a, d, a + d
    return df.withColumns(cols)


def with_midpoints(df: DataFrame, pairs: dict | None = None) -> DataFrame:
    """Midpoint of start/end ignoring a missing end (lat, lon, depth)."""
    pairs = pairs or {"lat": ("slat", "elat"), "lon": ("slong", "elong"), "depth": ("sdepth", "edepth")}
    return df.withColumns({k: N.mean_ignoring_null(a, b) for k, (a, b) in pairs.items()})


def recode(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Replace listed values (exact match), leave others unchanged."""
    expr = F.col(column)
    for old, new in mapping.items():
        expr = F.when(F.col(column) == F.lit(old), F.lit(new)).otherwise(expr)
    return df.withColumn(column, expr)


def normalise_vessel(df: DataFrame, column: str = "vessel", aliases: dict | None = None) -> DataFrame:
    """Lower-case the vessel name, then map known aliases to one name."""
    aliases = VESSEL_ALIASES if aliases is None else aliases
    return recode(df.withColumn(column, F.lower(F.col(column))), column, aliases)


def with_classes(df: DataFrame, hour: str | None = "start_hour", month: str | None = "mn",
                 hours: str | None = "hrs") -> DataFrame:
    """day/night, season and effort class columns (skip any given as None)."""
    cols = {}
    if hour:
        cols["day_night"] = C.day_night(hour)
    if month:
        cols["season"] = C.season(month)
    if hours:
        cols["effort_class"] = C.effort_class(hours)
    return df.withColumns(cols)


def cpue(count: str, hours: str = "hrs", scaler: float = 1000.0):
    """Catch per ``scaler`` hours of effort."""
    return F.lit(float(scaler)) * F.col(count) / F.col(hours)


def species_long(df: DataFrame, ids: list[str], species: list[str] | None = None,
                 value_name: str = "n") -> DataFrame:
    """One row per (shot, species) with the species total in ``value_name``."""
    species = species or list(SPECIES)
    return df.unpivot(ids, species, "species", value_name)


def with_grid_cell(df: DataFrame, lat: str = "slat", lon: str = "slong", parity: bool = True) -> DataFrame:
    """0.1-degree cell (truncated toward zero) and its centre."""
    return df.withColumns({
        "cell_lat": N.trunc_tenth(lat, parity), "cell_lon": N.trunc_tenth(lon, parity),
    }).withColumns({"centre_lat": N.cell_centre_lat("cell_lat"), "centre_lon": N.cell_centre_lon("cell_lon")})
