"""Explicit schemas for the reference's file formats (never infer at scale)."""

from pyspark.sql import types as T

# Shot log: one row per trawl shot, dates as d/M/yyyy text, clock times as H:m:s text.
SPECIES_COUNT_COLUMNS = ["SawfishNarrowALIVE", "SawfishNarrowDEAD", "SawfishGreenALIVE", "SawfishGreenDEAD"]
CATCH_COLUMNS = ["TotalCatch", "TotalDiscard", "TotalBEEmp", "TotalBSSnapper", "TotalThreadfin",
                 "TotalRedEmp", "TotalRankinCod", "TotalFrypan", "TotalSaddletail",
                 "TotalSpangledEmp", "TotalCrimSnapper", "TotalGoldband"]
EFFORT_COLUMNS = ["SWEEPS", "HEADROPE", "BRIDLE", "HRGridDistance"]

SHOT_SCHEMA = T.StructType(
    [T.StructField("HC", T.LongType(), True),
     T.StructField("VESSEL", T.StringType(), True),
     T.StructField("LFB", T.StringType(), True),
     T.StructField("UNLOAD", T.StringType(), True),
     T.StructField("StartDate", T.StringType(), True),
     T.StructField("StartTime", T.StringType(), True),
     T.StructField("EndDate", T.StringType(), True),
     T.StructField("EndTime", T.StringType(), True),
     T.StructField("SLAT", T.DoubleType(), True),
     T.StructField("ELAT", T.DoubleType(), True),
     T.StructField("SLONG", T.DoubleType(), True),
     T.StructField("ELONG", T.DoubleType(), True),
     T.StructField("SDEPTH", T.DoubleType(), True),
     T.StructField("EDEPTH", T.DoubleType(), True),
     T.StructField("AREA", T.StringType(), True)]
    + [T.StructField(c, T.IntegerType(), True) for c in SPECIES_COUNT_COLUMNS]
    + [T.StructField(c, T.DoubleType(), True) for c in CATCH_COLUMNS]
    + [T.StructField(c, T.DoubleType(), True) for c in EFFORT_COLUMNS]
)

SST_SCHEMA = T.StructType([
    T.StructField("Lat", T.DoubleType(), True),
    T.StructField("Long", T.DoubleType(), True),
    T.StructField("year", T.IntegerType(), True),
    T.StructField("month", T.IntegerType(), True),
    T.StructField("value", T.DoubleType(), True),
])

GRID_SCHEMA = T.StructType([
    T.StructField("lon", T.DoubleType(), True),
    T.StructField("lat", T.DoubleType(), True),
    T.StructField("depth", T.DoubleType(), True),
])
