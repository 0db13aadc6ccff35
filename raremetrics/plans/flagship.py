"""Shot log → cleaned, enriched shots → nominal CPUE per species and year (Entry A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean, derive, enrich, summarise
from ..sources import tables


@tables._plan_cache
def prepared_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared-table shots with totals, midpoints and the minimum-effort rule applied."""
    s = tables.shots(spark, sf_dir)
    s = derive.with_midpoints(derive.with_totals(s))
    return clean.min_effort(s)


def enriched_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage order of the reference (T25): climatology and annual effort join first,
    class variables next, blank vessels dropped last."""
    s = prepared_shots(spark, sf_dir)
    clim = enrich.climatology(tables.sst(spark, sf_dir))
    s = enrich.with_climatology(s, clim)
    s = enrich.with_annual_effort(s)
    s = derive.with_classes(s, hour=None)
    return clean.known_vessel(s)


def nominal_cpue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clean.known_vessel(prepared_shots(spark, sf_dir))
    return summarise.nominal_cpue(s)
