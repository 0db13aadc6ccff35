"""File sources (S1-S3) and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import GRID_SCHEMA, SHOT_SCHEMA, SST_SCHEMA


def read_shots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Shot-log CSV with a header; every text column stays text until parsed."""
    return spark.read.schema(SHOT_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_sst(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sea-surface temperature CSV (Lat, Long, year, month, value)."""
    return spark.read.schema(SST_SCHEMA).option("header", True).csv(path)


def read_grid_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S3: whitespace-delimited (lon lat depth) text grids, any number of files, unioned.

    Lines are split on runs of blanks; blank lines and short lines are dropped.
    """
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (spark.read.text(paths)
            .filter(F.trim(F.col("value")) != "")
            .select(*[F.try_element_at(parts, F.lit(i + 1)).cast("double").alias(f.name)
                      for i, f in enumerate(GRID_SCHEMA.fields)])
            .dropna(how="any"))


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header and no row names.

    ``single_file`` coalesces to one task and is meant for small result tables
    only (summaries, indices); large extracts are written in parallel.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Parquet result table, optionally partitioned (e.g. by year) for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
