"""Shot-log files in the reference's own layout, derived from the shared tables.

``write_shot_log_csv`` renders shots as the raw CSV (d/m/yyyy dates, H:M:S clock
times, upper-case column names) into a folder; ``read_shots`` + ``standardise_log``
read them back. This exercises S1 (read), S4 (write) and P1-P6 end to end on data
whose size grows with the shared tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import write_csv


def shots_as_log(shots: DataFrame) -> DataFrame:
    """Map canonical shots onto the raw log columns; effort becomes start/end clock times."""
    start = F.col("start_date").cast("timestamp_ntz")
    secs = F.round(F.col("hrs") * F.lit(3600.0)).cast("long")
    # wall-clock arithmetic on TIMESTAMP_NTZ: independent of the session time zone
    start6 = F.timestamp_add("HOUR", F.lit(6), start)
    end = F.timestamp_add("SECOND", secs, start6)
    fmt_d, fmt_t = "d/M/yyyy", "H:m:s"
    return shots.select(
        F.col("shot_id").alias("HC"), F.col("vessel").alias("VESSEL"), F.lit("f550").alias("LFB"),
        F.date_format(start, fmt_d).alias("UNLOAD"),
        F.date_format(start6, fmt_d).alias("StartDate"), F.date_format(start6, fmt_t).alias("StartTime"),
        F.when(secs.isNotNull(), F.date_format(end, fmt_d)).alias("EndDate"),
        F.when(secs.isNotNull(), F.date_format(end, fmt_t)).alias("EndTime"),
        F.col("slat").alias("SLAT"), F.col("elat").alias("ELAT"), F.col("slong").alias("SLONG"),
        F.col("elong").alias("ELONG"), F.col("sdepth").alias("SDEPTH"), F.col("edepth").alias("EDEPTH"),
        F.lit("A").alias("AREA"),
        F.col("narrow_alive").cast("int").alias("SawfishNarrowALIVE"),
        F.col("narrow_dead").cast("int").alias("SawfishNarrowDEAD"),
        F.col("green_alive").cast("int").alias("SawfishGreenALIVE"),
        F.col("green_dead").cast("int").alias("SawfishGreenDEAD"),
        F.col("total_catch").alias("TotalCatch"))


def write_shot_log_csv(shots: DataFrame, path: str) -> None:
    write_csv(shots_as_log(shots), path)


def grid_as_text(df: DataFrame, lon: str, lat: str, depth: str) -> DataFrame:
    """Render (lon lat depth) rows as whitespace-delimited text lines (S3 layout)."""
    return df.select(F.concat_ws("   ", F.format_string("%.4f", F.col(lon)), F.format_string("%.4f", F.col(lat)),
                                 F.format_string("%.1f", F.col(depth))).alias("value"))
