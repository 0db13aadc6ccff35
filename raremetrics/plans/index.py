"""Standardised catch-rate index from the hurdle-Poisson GAM (Entry B).

Stages: normalise vessel names → impute depth → model columns and 7 h cap → depth
outliers and vessel tenure → one long (species, shot) frame → presence GAMs for
both species fitted together (one job per IRLS pass) → truncated-Poisson intercepts
→ index on grids over year, month, longitude and effort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import effects, gam, zeroinfl
from ..operators import clean, derive, impute
from . import flagship

SPECIES = ["narrow", "green"]
FACTORS = ["yrs", "vessel"]
COVARIATES = ["mn", "hrs", "lon"]
ADAPTER_VESSEL_ALIASES = {"vessel 2 ii": "vessel 2"}
# Index grids: year by level; month, longitude and effort in 0.1 steps.
INDEX_TERMS = {"yrs": None, "mn": 0.1, "lon": 0.1, "hrs": 0.1}


def presence_terms():
    """s(month, cyclic, k=12) + hours + year factor + s(longitude, thin-plate) + vessel factor."""
    return [gam.Smooth("mn", 12, cyclic=True), gam.Linear("hrs"), gam.Factor("yrs"),
            gam.Smooth("lon", 10, basis="tp"), gam.Factor("vessel")]


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clean.known_vessel(flagship.prepared_shots(spark, sf_dir))
    s = derive.normalise_vessel(s, "vessel", ADAPTER_VESSEL_ALIASES)
    s = impute.impute_bagged(s, "depth", ["shot_id", "slat", "slong"])
    s = clean.max_effort(s)
    s = clean.depth_cut(s)
    s = clean.vessel_tenure(s, "vessel", "yr")
    return s.withColumn("yrs", F.col("yr").cast("string"))


def count_terms():
    """s(month, cyclic, k=12) + hours + year factor + s(longitude, thin-plate) + s(start hour, cyclic, k=24)."""
    return [gam.Smooth("mn", 12, cyclic=True), gam.Linear("hrs"), gam.Factor("yrs"), gam.Smooth("lon", 10, basis="tp"),
            gam.Smooth("start_hour", 24, cyclic=True)]


def long_frame(m: DataFrame) -> DataFrame:
    """One row per (species, shot) with the species count in ``n``."""
    cols = ["shot_id", "yrs", "vessel", "mn", "start_hour", "hrs", "lon"]
    return m.select(*cols, *SPECIES).unpivot(cols, SPECIES, "species", "n")


def fit(spark: SparkSession, sf_dir: str, m: DataFrame | None = None):
    m = model_frame(spark, sf_dir) if m is None else m
    return zeroinfl.fit_hurdle_poisson(long_frame(m), "n", presence_terms(), group="species")


def zip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_frame(spark, sf_dir).checkpoint(eager=True)
    fits = fit(spark, sf_dir, m)
    grid = effects.prediction_grid(m, INDEX_TERMS, FACTORS, ["mn", "hrs", "lon"], "rarest")
    return effects.zip_index(grid, fits, "species")


def boot_index(spark: SparkSession, sf_dir: str, replicates: int = 20, seed=666,
               method: str = "stratified") -> DataFrame:
    """G18 + M5: bootstrap percentile bands of the index.

    ``stratified``: exact same-size resampling within years (the reference's scheme);
    ``poisson``: Poisson(1) weights generated inside the fit (no data expansion);
    ``exact``: the reference's scheme without copies, smoothing re-estimated in every replicate.
    ``n_failed`` counts a species' replicates that did not converge or drew no catch; the bands leave those out."""
    from ..models import bootstrap
    m = model_frame(spark, sf_dir).checkpoint(eager=True)
    full = fit(spark, sf_dir, m)
    long = long_frame(m)
    if method == "poisson":
        fits, loglam = bootstrap.refit_poisson_replicates(long, full, "n", "species", "shot_id", replicates, seed)
    elif method == "exact":
        fits, loglam = bootstrap.refit_exact_replicates(long.withColumn("n", F.col("n").cast("double")), full, "n", "species", ["yrs"],
                                                        replicates, seed)
    else:
        fits, loglam = bootstrap.refit_replicates(long, full, "n", "n", "species", "shot_id", m, ["yr"],
                                                  replicates, seed)
    grid = effects.prediction_grid(m, INDEX_TERMS, FACTORS, ["mn", "hrs", "lon"], "rarest")
    preds = bootstrap.replicate_predictions(grid, fits, loglam, "species")
    failed = {}
    for g, _, converged, positive in bootstrap.statuses(fits, loglam):
        failed[g] = failed.get(g, 0) + (not (converged and positive))
    of = F.create_map(*[F.lit(x) for g, n in sorted(failed.items()) for x in (g, n)])
    return bootstrap.summarise_replicates(preds, ["species", "term", "x"]).withColumn("n_failed", of[F.col("species")])
