"""Nominal CPUE maintained incrementally as new shot-log files land in a folder.

The same column rules as the batch path (``derive.standardise_log`` and the
cleaning filters) are applied to a file stream; the state per (species, year) is
Spark's count / mean / central second moment (numerically stable, merged across
micro-batches), so the state is bounded by species × years and the CI is derived
when the result is read. Checkpoints go to the shared checkpoint folder
so a restarted query resumes without reprocessing files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, derive
from ..operators.summarise import Z95
from ..session import ensure_checkpoint_dir
from ..sources.schema import SHOT_SCHEMA


def shot_log_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming source over CSV shot logs with the explicit schema."""
    return (spark.readStream.schema(SHOT_SCHEMA).option("header", True)
            .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))


def cpue_state(raw: DataFrame, scaler: float = 1000.0, rules: DataFrame | None = None) -> DataFrame:
    """Per (species, year): n, mean and sample sd of cleaned shots' cpue (batch or stream).

    Shots in the exclusion table ``rules`` are left out; without one, none are."""
    s = derive.standardise_log(raw)
    s = clean.exclude_ids(s, "shot_id", rules) if rules is not None else s
    s = clean.known_vessel(clean.min_effort(s))
    long = s.select("yr", "hrs", *derive.SPECIES).unpivot(["yr", "hrs"], list(derive.SPECIES), "species", "__n")
    c = F.lit(float(scaler)) * F.col("__n") / F.col("hrs")
    return (long.select("species", "yr", c.alias("cpue")).groupBy("species", "yr")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("cpue").alias("mean"), F.stddev_samp("cpue").alias("sd")))


def cpue_from_state(state: DataFrame) -> DataFrame:
    """Nominal CPUE table (mean, n, sd, 95 % CI) from the state."""
    half = F.lit(Z95) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return state.select("species", "yr", "mean", "n", "sd",
                        (F.col("mean") - half).alias("low_cl"), (F.col("mean") + half).alias("upp_cl"))


def start_cpue_stream(spark: SparkSession, folder: str, table: str, checkpoint: str | None = None,
                      trigger_once: bool = False):
    """Run the incremental aggregate into an in-session table (``complete`` mode, the
    state is bounded). Returns the StreamingQuery."""
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", table)
    w = (cpue_state(shot_log_stream(spark, folder)).writeStream.outputMode("complete")
         .format("memory").queryName(table).option("checkpointLocation", ckpt))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
