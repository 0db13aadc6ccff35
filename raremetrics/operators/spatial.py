"""Gridded effort and catch maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N

N_EFFORT_CLASSES = 20  # fixed: number of colour classes of the effort maps


def effort_grid(df: DataFrame, by: list[str] | None = None, lat: str = "slat", lon: str = "slong",
                hours: str = "hrs", parity: bool = True) -> DataFrame:
    """Effort summed per 0.1° cell (truncated start position), optionally per ``by`` keys.

    Rows with null effort or position are dropped (formula NA rule)."""
    by = by or []
    cell_lat, cell_lon = N.trunc_tenth(lat, parity), N.trunc_tenth(lon, parity)
    d = (df.select(*by, cell_lat.alias("cell_lat"), cell_lon.alias("cell_lon"), F.col(hours).alias("__h"))
         .dropna(subset=by + ["cell_lat", "cell_lon", "__h"]))
    return (d.groupBy(*by, "cell_lat", "cell_lon").agg(F.sum("__h").alias("hrs"), F.count(F.lit(1)).alias("shots"))
            .withColumns({"centre_lat": N.cell_centre_lat("cell_lat"), "centre_lon": N.cell_centre_lon("cell_lon")}))


def effort_classes(grid: DataFrame, value: str = "hrs", n: int = N_EFFORT_CLASSES) -> DataFrame:
    """Colour class of each cell for breaks 0, then ``n`` points evenly from min to max.

    Class 1 is (0, min]; class k+1 is (min+(k-1)w, min+k·w] with w = (max−min)/(n−1).
    Min and max come from one global aggregate over the (already aggregated) grid.
    """
    rng = grid.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    w = (F.col("__hi") - F.col("__lo")) / F.lit(float(n - 1))
    k = F.when((F.col(value) <= F.col("__lo")) | (w == 0), F.lit(1)).otherwise(
        F.lit(1) + F.ceil((F.col(value) - F.col("__lo")) / w))
    return (grid.crossJoin(F.broadcast(rng))
            .withColumn("effort_class", F.least(F.lit(n), k).cast("int")).drop("__lo", "__hi"))


def panel_catch(df: DataFrame, panel: str, species: list[str]) -> DataFrame:
    """Catch totals and positive points per map panel (e.g. year), per species."""
    long = df.select(panel, *species).unpivot([panel], species, "species", "__k")
    return (long.groupBy(panel, "species")
            .agg(F.sum("__k").cast("bigint").alias("catch"),
                 F.sum(F.when(F.col("__k") > 0, 1).otherwise(0)).cast("bigint").alias("positive_points")))


def grid_wide(grid: DataFrame, row_key: str, col_key: str, value: str, col_values: list,
              prefix: str = "v") -> DataFrame:
    """R2: long → wide matrix. The pivot values are given explicitly so the plan needs
    no extra distinct-values job and the output schema is fixed."""
    names = {v: f"{prefix}{str(v).replace('-', 'm').replace('.', '_')}" for v in col_values}
    w = grid.groupBy(row_key).pivot(col_key, col_values).agg(F.first(value))
    return w.select(row_key, *[F.col(f"`{str(v)}`").alias(names[v]) for v in col_values])
