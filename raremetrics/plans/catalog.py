"""Registered queries: name → (spark, sf_dir) → DataFrame over the shared tables.

Results are rounded (doubles to 6 digits) so they compare exactly with the
DuckDB oracle in ``oracle.py`` regardless of summation order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import compute_partitions, ensure_checkpoint_dir
from . import flagship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column to ``digits`` (output presentation only)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


@query("nominal_cpue")
def q_nominal_cpue(spark, sf_dir):
    """A1 (flagship): nominal CPUE per species and year with 95 % CI."""
    return flagship.nominal_cpue(spark, sf_dir)


# --------------------------------------------------------------------------- base frames
from ..functions import classes as C  # noqa: E402
from ..functions import dates as D  # noqa: E402
from ..functions import numeric as N  # noqa: E402
from ..operators import bins, clean, derive, describe, enrich, quantiles, spatial, summarise  # noqa: E402
from ..sources import tables  # noqa: E402

SPECIES = ["narrow", "green"]
ADAPTER_VESSEL_ALIASES = {"vessel 2 ii": "vessel 2"}
SST_BOUNDS = dict(lat_range=(-21.0, -17.0), lon_range=(114.0, 121.0))


def _prepared(spark, d):
    return flagship.prepared_shots(spark, d)


def _known(spark, d):
    return clean.known_vessel(_prepared(spark, d))


def _model_frame(spark, d):
    """Known-vessel shots with normalised names and class columns, effort capped at 7 h."""
    k = derive.normalise_vessel(_known(spark, d), "vessel", ADAPTER_VESSEL_ALIASES)
    return clean.max_effort(derive.with_classes(k, hour=None))


def _fit_frame(spark, d):
    """The shots that models are fitted to: depth imputed and cut, vessels with tenure, class columns."""
    return derive.with_classes(index_plan.model_frame(spark, d), hour=None)


# --------------------------------------------------------------------------- step 1
@query("climatology")
def q_climatology(spark, d):
    """A2 + F6: month climatology of temperature inside the bounding box."""
    return enrich.climatology(tables.sst(spark, d))


@query("climatology_year_month")
def q_climatology_ym(spark, d):
    """A2: mean temperature by year and month."""
    return enrich.climatology(tables.sst(spark, d), by=["yr", "mn"])


@query("annual_totals")
def q_annual_totals(spark, d):
    """A3: annual sums of both species and effort with the any-null drop."""
    return enrich.annual_totals(_prepared(spark, d))


@query("shots_enriched")
def q_shots_enriched(spark, d):
    """J1 + J2 + P10-P11 + F4 in the reference's stage order."""
    return flagship.enriched_shots(spark, d).select(
        "shot_id", "vessel", "yr", "mn", "lat", "lon", "depth", "hrs", "narrow", "green",
        "temperature", "ann_eff", "season", "effort_class")


# --------------------------------------------------------------------------- step 2
@query("effort_class")
def q_effort_class(spark, d):
    """Shots, effort and catch per season × effort class."""
    k = derive.with_classes(_known(spark, d), hour=None)
    return k.groupBy("season", "effort_class").agg(
        F.count(F.lit(1)).alias("shots"), F.sum("hrs").alias("hrs"),
        F.sum("narrow").cast("bigint").alias("narrow"), F.sum("green").cast("bigint").alias("green"))


@query("day_night")
def q_day_night(spark, d):
    """Shots, effort and catch by day/night class (hour-of-day shots)."""
    h = clean.min_effort(tables.shots_hourly(spark, d)).withColumn("day_night", C.day_night("start_hour"))
    return h.groupBy("day_night").agg(
        F.count(F.lit(1)).alias("shots"), F.sum("hrs").alias("hrs"),
        F.sum("narrow").cast("bigint").alias("narrow"), F.sum("green").cast("bigint").alias("green"))


@query("effort_grid")
def q_effort_grid(spark, d):
    """P16 + A18: effort per 0.1° cell of the start position."""
    return spatial.effort_grid(_known(spark, d))


@query("effort_grid_year")
def q_effort_grid_year(spark, d):
    """Effort per 0.1° cell and year."""
    return spatial.effort_grid(_known(spark, d), by=["yr"])


@query("effort_grid_class")
def q_effort_grid_class(spark, d):
    """20 effort classes of the gridded effort."""
    return spatial.effort_classes(spatial.effort_grid(_known(spark, d)))


@query("range_audit")
def q_range_audit(spark, d):
    """date parts outside their bounds, one long violations table."""
    s = tables.shots(spark, d).withColumn("dy", F.dayofmonth("start_date").cast("int"))
    return clean.range_audit(s, "shot_id", {"yr": (1995, 2000), "mn": (1, 12), "dy": (1, 28)})


@query("vessel_tenure")
def q_vessel_tenure(spark, d):
    """skippers with records in more than 5 distinct years, with their shots."""
    kept = clean.vessel_tenure(_known(spark, d), vessel="skipper_no")
    return kept.groupBy("skipper_no").agg(F.count(F.lit(1)).alias("shots"),
                                          F.count_distinct("yr").alias("n_years"))


@query("exclude_ids")
def q_exclude_ids(spark, d):
    """drop shots listed in an exclusion table (orders with an oversized line)."""
    rules = tables.table(spark, d, "lineitem").filter(F.col("l_quantity") >= 50).select("l_orderkey")
    kept = clean.exclude_ids(_prepared(spark, d), "shot_id", rules)
    return kept.groupBy("yr").agg(F.count(F.lit(1)).alias("shots"))


@query("level_audit")
def q_level_audit(spark, d):
    """distinct levels per factor and the > 32 flag."""
    e = flagship.enriched_shots(spark, d)
    return clean.level_audit(e, ["vessel", "yr", "mn", "season", "effort_class", "skipper_no"])


@query("effort_audit")
def q_effort_audit(spark, d):
    """shots and catch above vs within the 7 h cap."""
    return clean.effort_audit(_known(spark, d))


# --------------------------------------------------------------------------- step 3
@query("catch_effort_profile")
def q_catch_effort_profile(spark, d):
    """Catch, effort, shots by month and 10 m depth bin (one grouping-sets pass)."""
    k = _known(spark, d)
    return summarise.catch_effort_profile(k, {"mn": "mn", "depth_bin": N.round_to("depth", 10)}, SPECIES)


@query("mean_cpue_by_dims")
def q_mean_cpue_by_dims(spark, d):
    """Mean narrow cpue by year, month and depth bin."""
    k = _known(spark, d)
    return summarise.mean_by_dims(k, {"yr": "yr", "mn": "mn", "depth_bin": N.round_to("depth", 10)},
                                  F.col("narrow") / F.col("hrs"))


@query("catch_frequency_pct")
def q_catch_frequency(spark, d):
    """A13 + W1: records per number caught among positive shots and % of the total."""
    return summarise.catch_frequency(_known(spark, d), SPECIES)


@query("count_distribution")
def q_count_distribution(spark, d):
    """Records per number caught including zeros."""
    return summarise.count_distribution(_known(spark, d), SPECIES)


@query("occurrence")
def q_occurrence(spark, d):
    """% of shots with any catch and per species."""
    return summarise.occurrence(_known(spark, d), SPECIES)


@query("table1")
def q_table1(spark, d):
    """Grand totals."""
    return summarise.table1(_known(spark, d))


@query("annual_catch")
def q_annual_catch(spark, d):
    """alive/dead catch per year."""
    return summarise.annual_catch(_known(spark, d))


@query("annual_effort")
def q_annual_effort(spark, d):
    """Effort per year in thousands of hours."""
    return summarise.annual_effort(_known(spark, d))


@query("effort_by_month")
def q_effort_by_month(spark, d):
    """A4: rounded effort per month of shots within the 7 h cap."""
    return summarise.effort_by(clean.max_effort(_known(spark, d)), "mn")


@query("catch_map")
def q_catch_map(spark, d):
    """A5 + J4: narrow catch per month × position with the month's effort label."""
    return summarise.catch_map(clean.max_effort(_known(spark, d)), "mn", "narrow")


def _by_end_month(spark, d):
    """Known shots within the 7 h cap, with the month in which they end."""
    return clean.max_effort(_known(spark, d)).withColumn("end_mn", F.month(D.end_date("start_date", "start_hour", "hrs")).cast("int"))


@query("effort_by_end_month")
def q_effort_by_end_month(spark, d):
    """A4: rounded effort per month in which the shots end."""
    return summarise.effort_by(_by_end_month(spark, d), "end_mn")


@query("catch_map_end_month")
def q_catch_map_end_month(spark, d):
    """A5 + J4: catch of both species per end month × position with the month's effort label."""
    shots = _by_end_month(spark, d)
    maps = [summarise.catch_map(shots, "end_mn", s).withColumn("species", F.lit(s)) for s in SPECIES]
    return maps[0].unionByName(maps[1])


@query("level_catch")
def q_level_catch(spark, d):
    """Catch by level of each model factor."""
    return summarise.level_catch(_model_frame(spark, d), ["yr", "season", "vessel", "effort_class"], SPECIES)


@query("predictor_positive")
def q_predictor_positive(spark, d):
    """A10: positive shots per predictor level (factors, and 10 equal bins of numerics)."""
    return summarise.positive_by_level(_known(spark, d), ["vessel", "yr", "mn"],
                                       {"lon": 10, "lat": 10, "depth": 10}, SPECIES)


@query("boxplot_stats")
def q_boxplot_stats(spark, d):
    """Boxplot statistics of positive narrow cpue per year."""
    k = _known(spark, d).filter(F.col("narrow") > 0).withColumn("cpue", F.col("narrow") / F.col("hrs"))
    return describe.boxplot_stats(k, "cpue", ["yr"])


@query("hist_counts")
def q_hist_counts(spark, d):
    """Histogram of effort in 0.5 h bins."""
    return bins.histogram(_known(spark, d), "hrs", 0.5)


@query("percentiles")
def q_percentiles(spark, d):
    """Effort percentiles 0, 1, ..., 100 % over all shots (as the reference's seq(0, 1, .01))."""
    return describe.percentiles(_known(spark, d), "hrs", [i / 100 for i in range(101)])


@query("relative_index")
def q_relative_index(spark, d):
    """Nominal cpue and band divided by the species' series mean."""
    idx = flagship.nominal_cpue(spark, d)
    return summarise.relative_index(idx, ["species"], ["mean", "low_cl", "upp_cl"]).select(
        "species", "yr", "mean", "low_cl", "upp_cl")


@query("reference_profile")
def q_reference_profile(spark, d):
    """Rarest level per factor and covariate means (the prediction reference)."""
    return describe.reference_profile(_model_frame(spark, d), ["yr", "season", "vessel", "effort_class"],
                                      ["hrs", "lon", "lat"], "rarest")


@query("modal_profile")
def q_modal_profile(spark, d):
    """Modal level per factor and covariate means."""
    return describe.reference_profile(_model_frame(spark, d), ["yr", "season", "vessel", "effort_class"],
                                      ["hrs", "lon", "lat"], "modal")


@query("panel_rate")
def q_panel_rate(spark, d):
    """Each shot's landings per hour trawled, scaled by the largest rate of its year."""
    k = _known(spark, d).withColumn("landings_t", F.col("total_catch") / F.lit(1000.0))
    return summarise.panel_rate(k, "yr", ["shot_id", "slong", "slat"], "landings_t").drop("rate")


@query("grid_wide")
def q_grid_wide(spark, d):
    """R2: effort per longitude cell (rows) × month (columns)."""
    g = spatial.effort_grid(_known(spark, d), by=["mn"]).groupBy("cell_lon", "mn").agg(F.sum("hrs").alias("hrs"))
    return spatial.grid_wide(g, "cell_lon", "mn", "hrs", list(range(1, 13)), prefix="m")


@query("vessel_years")
def q_vessel_years(spark, d):
    """Vessel × year presence (long)."""
    return clean.vessel_years(_known(spark, d), "vessel", "yr")


@query("panel_catch")
def q_panel_catch(spark, d):
    """Catch totals and positive points per year panel and species."""
    return spatial.panel_catch(_known(spark, d), "yr", SPECIES)


@query("class_proportions")
def q_class_proportions(spark, d):
    """Two-way class proportions (season × effort class)."""
    return summarise.class_proportions(_model_frame(spark, d), ["season", "effort_class"])


# --------------------------------------------------------------------------- step 4
@query("corr_matrix")
def q_corr_matrix(spark, d):
    """Pairwise correlation of covariates."""
    return describe.corr_matrix(_known(spark, d), ["lat", "lon", "depth", "hrs"])


@query("kde_grid")
def q_kde_grid(spark, d):
    """Density of effort per season on 512 points, bandwidth doubled (adjust = 2)."""
    return describe.kde(_model_frame(spark, d), "hrs", ["season"], adjust=2.0)


@query("effort_bins")
def q_effort_bins(spark, d):
    """Shots and interactions per 30-min effort bin."""
    return bins.effort_bins(_model_frame(spark, d))


@query("chisq_independence")
def q_chisq(spark, d):
    """χ² of interactions vs shots over the effort bins (statistic and df)."""
    b = bins.effort_bins(_model_frame(spark, d))
    return describe.chisq_contingency(b, "interactions", "shots").select("statistic", "df", "n")


@query("equal_width_cut")
def q_equal_width_cut(spark, d):
    """Shots per 10 equal-width longitude bins."""
    return bins.equal_width_cut(_known(spark, d), "lon", 10).groupBy("bin").agg(F.count(F.lit(1)).alias("shots"))


# --------------------------------------------------------------------------- step 7: live model path
from ..models import effects, gam as gam_mod, zeroinfl  # noqa: E402
from ..operators import impute  # noqa: E402
from . import index as index_plan  # noqa: E402


@query("zip_index")
def q_zip_index(spark, d):
    """G6 + M2/M3: hurdle-Poisson GAM index by year, month, longitude, effort (rows-only)."""
    return index_plan.zip_index(spark, d)


@query("zip_index_annual")
def q_zip_index_annual(spark, d):
    """M4: the annual index exported with FINYEAR, MEAN, LOW, UP per species (rows-only)."""
    idx = index_plan.zip_index(spark, d).filter(F.col("term") == "yrs")
    return idx.select("species", F.col("x").cast("int").alias("FINYEAR"), F.col("mean").alias("MEAN"),
                      F.col("low").alias("LOW"), F.col("up").alias("UP"))


def _fits_table(spark, fits: dict, kind: str):
    """Small per-species result tables of fitted models (p rows per species)."""
    import pandas as pd
    frames = []
    for k, f in fits.items():
        t = f.presence.term_table() if kind == "terms" else f.presence.coefficients()
        t.insert(0, "species", k)
        frames.append(t)
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))


@query("gam_terms")
def q_gam_terms(spark, d):
    """Presence-GAM term table (Wald χ², edf, p) per species (rows-only)."""
    fits = index_plan.fit(spark, d)
    return _fits_table(spark, fits, "terms")


@query("gam_coefficients")
def q_gam_coefficients(spark, d):
    """Presence-GAM coefficients with standard errors per species (rows-only)."""
    fits = index_plan.fit(spark, d)
    return _fits_table(spark, fits, "coef")


@query("overdispersion")
def q_overdispersion(spark, d):
    """G3 + G5: Poisson GAM per species, then the dispersion estimate α (rows-only)."""
    m = index_plan.model_frame(spark, d).checkpoint(eager=True)
    long = index_plan.long_frame(m)
    terms = index_plan.count_terms()
    fits = gam_mod.fit_gam(long, "n", terms, family="poisson", group="species")
    pred = gam_mod.predict_frame({f.group: f for f in fits}, long, "species", "eta", "se")
    return zeroinfl.overdispersion(pred.withColumn("mu", F.exp("eta")), "n", "mu", ["species"])


@query("depth_imputed")
def q_depth_imputed(spark, d):
    """Q1 + P14 + J3: bagged-tree depth imputation; summary by missing flag (rows-only)."""
    s = _known(spark, d)
    imp = impute.impute_bagged(s, "depth", ["shot_id", "slat", "slong"])
    return imp.groupBy("depth_missing").agg(F.count(F.lit(1)).alias("shots"), F.avg("depth").alias("mean_depth"),
                                            F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))


# --------------------------------------------------------------------------- step 5: sampling and metrics
from ..models import evaluate  # noqa: E402
from ..operators import features, sampling  # noqa: E402


def _presence_frame(spark, d):
    return _known(spark, d).withColumn("presence", (F.col("narrow") > 0).cast("int"))


@query("stratified_split")
def q_stratified_split(spark, d):
    """Q5: exact 70/30 split per presence class, hash-ordered."""
    s = sampling.stratified_split(_presence_frame(spark, d), ["presence"], "shot_id", 0.7, 666)
    return s.select("shot_id", "presence", "split")


@query("cv_folds")
def q_cv_folds(spark, d):
    """Q8: 10-fold × 3 repeats stratified fold labels."""
    s = sampling.cv_folds(_presence_frame(spark, d), ["presence"], "shot_id", 10, 3, 666)
    return s.select("shot_id", "presence", "repeat", "fold")


@query("bootstrap_draws")
def q_bootstrap_draws(spark, d):
    """Q7: stratified (by year) bootstrap draw counts for 5 replicates."""
    return sampling.bootstrap_counts(_known(spark, d), ["yr"], "shot_id", 5, 666)


def _species_scores(spark, d):
    k = _known(spark, d)
    return (k.select("hrs", *SPECIES).unpivot(["hrs"], SPECIES, "species", "n")
            .withColumn("presence", (F.col("n") > 0).cast("int")))


@query("auc_exact")
def q_auc_exact(spark, d):
    """M7/M8: exact AUC of effort as a presence score, per species."""
    return evaluate.auc(_species_scores(spark, d), "presence", "hrs", ["species"])


@query("roc_curve")
def q_roc_curve(spark, d):
    """M7: ROC points (threshold, sensitivity, specificity) per species."""
    return evaluate.roc_curve(_species_scores(spark, d), "presence", "hrs", ["species"])


@query("confusion")
def q_confusion(spark, d):
    """M9: confusion counts and rates of the rule hrs/7 ≥ 0.5, per species."""
    s = _species_scores(spark, d).withColumn("score", F.col("hrs") / F.lit(7.0))
    return evaluate.confusion(s, "presence", "score", 0.5, ["species"])


@query("scaled_covariates")
def q_scaled_covariates(spark, d):
    """Q2: centred and scaled covariates per shot."""
    cols = ["hrs", "lat", "lon", "mn"]
    return features.centre_scale(_known(spark, d).select("shot_id", *cols), cols)


@query("boot_index")
def q_boot_index(spark, d):
    """G18 + M5/M6: 20 stratified bootstrap refits of the hurdle index, percentile bands (rows-only)."""
    return index_plan.boot_index(spark, d, 20, 666)


# --------------------------------------------------------------------------- step 6: MLlib learners
from ..models import classify, glm as glm_mod  # noqa: E402


def _classification_frame(spark, d):
    """Model frame with presence label, assembled features and a 70/30 split."""
    m = derive.with_classes(_model_frame(spark, d), hour=None)
    m = m.withColumn("label", (F.col("narrow") > 0).cast("double"))
    ensure_checkpoint_dir(spark)
    # the split reads its rows twice, the encoders read the split three times
    m = m.select("shot_id", "label", "season", "effort_class", "hrs", "lon", "lat", "mn").checkpoint(eager=True)
    m = sampling.stratified_split(m, ["label"], "shot_id", 0.7, 666).checkpoint(eager=True)
    m, _ = features.encode_factors(m, ["season", "effort_class"])
    return features.assemble(m, ["season_vec", "effort_class_vec", "hrs", "lon", "lat", "mn"], "features")


#: Fewest rows of a part when a frame is dealt to all cores for fitting.
FIT_ROWS = 10_000


@query("model_comparison")
def q_model_comparison(spark, d):
    """G10-G17 + M7/M8 + M9: learners trained on the 70 % part, AUC and confusion on the 30 % (rows-only)."""
    from functools import reduce
    m = _classification_frame(spark, d).select("label", "features", "split").checkpoint(eager=True)
    # the fits are bound by CPU: a large frame in few parts leaves cores idle in each of their passes
    parts = min(compute_partitions(spark), m.count() // FIT_ROWS)
    if m.rdd.getNumPartitions() < parts:
        m = m.repartition(parts).checkpoint(eager=True)
    train, test = m.filter(F.col("split") == "train"), m.filter(F.col("split") == "test")
    scored = []
    for name, model in classify.fit_all(classify.learners(), train).items():
        p = classify.positive_score(model.transform(test)).select(F.lit(name).alias("model"), "label", "score",
                                                                  F.col("prediction").alias("predicted"))
        scored.append(p)
    for name, p in discriminant.discriminant_scores(train, test, "label", "features").items():
        scored.append(p.select(F.lit(name).alias("model"), "label", "score", F.col("prediction").alias("predicted")))
    s = reduce(lambda a, b: a.unionByName(b), scored).checkpoint(eager=True)
    a = evaluate.auc(s, "label", "score", ["model"])
    return a.join(evaluate.confusion(s, "label", "predicted", 0.5, ["model"]), "model")


@query("glm_anova")
def q_glm_anova(spark, d):
    """G1 + M13: binomial logit GLM with sequential analysis of deviance (rows-only)."""
    m = _fit_frame(spark, d).withColumn(
        "label", (F.col("narrow") > 0).cast("double")).withColumn("yrs", F.col("yr").cast("string"))
    terms = [("yrs", "factor"), ("season", "factor"), ("vessel", "factor"), ("lon", "numeric"), ("hrs", "numeric")]
    return spark.createDataFrame(glm_mod.sequential_anova(m, "label", terms, "binomial", "logit"))


@query("marginal_effects")
def q_marginal_effects(spark, d):
    """E1 + Q9: season × effort effect on presence per species: effort in 0.1 h steps from its
    minimum to its 90th percentile, year and vessel at their modal level, longitude and depth
    at their mean (rows-only)."""
    m = _fit_frame(spark, d).checkpoint(eager=True)
    keep = ["shot_id", "yrs", "season", "vessel", "lon", "depth", "hrs"]
    long = m.select(*keep, *SPECIES).unpivot(keep, SPECIES, "species", "k").withColumn("p", (F.col("k") > 0).cast("double"))
    fits = gam_mod.fit_gam(long, "p", [gam_mod.Factor("yrs"), gam_mod.Factor("season"), gam_mod.Factor("vessel"),
                                       gam_mod.Linear("lon"), gam_mod.Linear("depth"), gam_mod.Linear("hrs")],
                           family="binomial", link="logit", group="species")
    top = quantiles.exact_quantiles(m, "hrs", [0.9]).select(F.round("quantile", 1).alias("top"))
    span = m.agg(F.round(F.min("hrs"), 1).alias("low")).crossJoin(top)        # one row each
    steps = span.select(F.explode(F.sequence(F.lit(0), F.round((F.col("top") - F.col("low")) * 10).cast("int"))).alias("k"), "low")
    effort = steps.select(F.round(F.col("low") + F.col("k") / 10, 1).alias("hrs"))
    ref = effects.reference_row(m, ["yrs", "vessel"], ["lon", "depth"], "modal")
    grid = (m.select("season").dropna().distinct().crossJoin(effort).crossJoin(ref)
            .withColumn("species", F.explode(F.array(*[F.lit(f.group) for f in fits]))))
    pred = gam_mod.predict_frame({f.group: f for f in fits}, grid, "species", "eta", "se")
    return effects.response_band(pred, "logit").select("species", "season", "hrs", "fit", "low", "up")


@query("partial_dependence")
def q_partial_dependence(spark, d):
    """E6 + E3: partial dependence of presence on effort, centred on the link scale (rows-only)."""
    m = _fit_frame(spark, d).withColumn("label", (F.col("narrow") > 0).cast("double"))
    fit = gam_mod.fit_gam(m, "label", [gam_mod.Linear("hrs"), gam_mod.Smooth("lon", 10)],
                          family="binomial", link="logit")[0]
    pd_ = effects.partial_dependence(m.select("hrs", "lon"), fit, "hrs", 20)
    return effects.centre_effect(pd_, [], "pd_link")


# --------------------------------------------------------------------------- step 9: file sources and sinks
import os as _os  # noqa: E402
import uuid as _uuid  # noqa: E402

from ..session import scratch_path  # noqa: E402
from ..sources import files, logbook  # noqa: E402


@query("shot_log_roundtrip")
def q_shot_log_roundtrip(spark, d):
    """S1 + S4 + P1-P7 + F1, F3 + A1: shots written as the raw CSV log, read back with the
    explicit schema, parsed and cleaned, then nominal CPUE (same numbers as the flagship)."""
    path = scratch_path(spark, f"shot_log_{_uuid.uuid4().hex}")
    logbook.write_shot_log_csv(tables.shots(spark, d), path)
    raw = files.read_shots(spark, path)
    s = derive.recode(derive.standardise_log(raw), "lfb", derive.LFB_RECODE)
    s = clean.year_window(s, "yr", 1994, 2001)
    s = clean.known_vessel(clean.min_effort(s))
    return summarise.nominal_cpue(s)


@query("grid_text")
def q_grid_text(spark, d):
    """S3: whitespace-delimited bathymetry-style grids read back from two files (every
    known-vessel shot's start position and depth, split in two halves by id parity so
    both files are needed), unioned, and summarised per 1° longitude."""
    base = scratch_path(spark, f"grid_{_uuid.uuid4().hex}")
    s = _known(spark, d)
    for i, part in enumerate([s.filter(F.col("shot_id") % 2 == 0), s.filter(F.col("shot_id") % 2 == 1)]):
        logbook.grid_as_text(part.dropna(subset=["slong", "slat", "sdepth"]), "slong", "slat", "sdepth") \
            .write.mode("overwrite").text(_os.path.join(base, f"part{i}"))
    g = files.read_grid_text(spark, [_os.path.join(base, "part0"), _os.path.join(base, "part1")])
    return g.groupBy(N.round_to("lon", 1).alias("lon_bin")).agg(
        F.count(F.lit(1)).alias("points"), F.avg("depth").alias("mean_depth"))


# --------------------------------------------------------------------------- more inventory rows
@query("landings_profile")
def q_landings_profile(spark, d):
    """A9 + P22: landings (tonnes) and shots by month and depth bin where each species was caught."""
    k = _known(spark, d).withColumn("landings_t", F.col("total_catch") / F.lit(1000.0))
    return summarise.catch_effort_profile(k, {"mn": "mn", "depth_bin": N.round_to("depth", 10)}, SPECIES,
                                          hours="landings_t", measure_name="landings_t")


@query("bin_weights")
def q_bin_weights(spark, d):
    """Inverse-frequency weights per 30-min effort bin; summary per bin."""
    k = clean.max_effort(_known(spark, d)).withColumn("bin", N.cut_fixed_width("hrs", 0.5, 7.0))
    w = bins.inverse_frequency_weights(k.filter(F.col("bin").isNotNull()), "bin")
    return w.groupBy("bin").agg(F.count(F.lit(1)).alias("shots"), F.sum("weight").alias("weight_sum"),
                                F.first("weight").alias("weight"))


@query("class_table")
def q_class_table(spark, d):
    """Observed × predicted presence (rule hrs/7 ≥ 0.5) over all class pairs, absent pairs as 0."""
    k = _known(spark, d).select((F.col("narrow") > 0).cast("int").alias("observed"),
                                (F.col("hrs") / F.lit(7.0) >= 0.5).cast("int").alias("predicted"))
    classes = k.select(F.col("observed").alias("c")).union(k.select("predicted")).distinct()
    return evaluate.class_table(k, "observed", "predicted", classes)


@query("cv_resample_summary")
def q_cv_resample_summary(spark, d):
    """Q8 + M11: held-out AUC of the effort score per (repeat, fold), summarised (rows-only)."""
    f = sampling.cv_folds(_presence_frame(spark, d), ["presence"], "shot_id", 10, 3, 666)
    per = evaluate.auc(f, "presence", "hrs", ["repeat", "fold"])
    return evaluate.resample_summary(per, [], ["auc"])


@query("negbin_gam")
def q_negbin_gam(spark, d):
    """Negative-binomial GAM per species with θ by maximum likelihood (rows-only)."""
    import pandas as pd
    m = index_plan.model_frame(spark, d).checkpoint(eager=True)
    long = index_plan.long_frame(m)
    terms = index_plan.count_terms()
    res = zeroinfl.fit_negbin_gam(long, "n", terms, group="species", rounds=2)
    rows = [{"species": g, "theta": th, "deviance": f.deviance, "edf": float(f.edf.sum()),
             "iterations": f.iterations, "converged": f.converged} for g, (f, th) in res.items()]
    return spark.createDataFrame(pd.DataFrame(rows))


@query("importance")
def q_importance(spark, d):
    """G10 + M12: boosted-tree variable importance folded back to input terms (rows-only)."""
    import pandas as pd
    m = _classification_frame(spark, d).select("label", "features", "split").checkpoint(eager=True)  # read by every tree
    model = classify.learners()["gbm"].fit(m.filter(F.col("split") == "train"))
    names = ["season=SprSu", "effort_class=Short", "effort_class=Standard", "hrs", "lon", "lat", "mn"]
    imp = classify.importance(model, names)
    terms = {}
    for n, v in imp:
        terms[n.split("=")[0]] = terms.get(n.split("=")[0], 0.0) + v
    return spark.createDataFrame(pd.DataFrame({"term": list(terms), "importance": list(terms.values())}))


@query("cv_glm")
def q_cv_glm(spark, d):
    """Logistic regression tuned by 10-fold stratified CV on the training part (rows-only)."""
    import pandas as pd
    from pyspark.ml.tuning import ParamGridBuilder
    m = _classification_frame(spark, d).filter(F.col("split") == "train").drop("split")
    m = sampling.cv_folds(m, ["label"], "shot_id", 10, 1, 666).drop("repeat").withColumn(
        "fold", F.col("fold") - 1).checkpoint(eager=True)
    lr = classify.learners()["glm"]
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.01, 0.1]).build()
    cvm = classify.cross_validate(lr, m, fold_col="fold", grid=grid)
    return spark.createDataFrame(pd.DataFrame({"reg_param": [0.0, 0.01, 0.1], "mean_auc": list(cvm.avgMetrics)}))


@query("hurdle_glm")
def q_hurdle_glm(spark, d):
    """Hurdle Poisson GLM per species (logit presence on linear terms + truncated Poisson) (rows-only)."""
    import pandas as pd
    m = index_plan.model_frame(spark, d).checkpoint(eager=True)
    long = index_plan.long_frame(m)
    fits = zeroinfl.fit_hurdle_poisson(long, "n", [gam_mod.Linear("hrs"), gam_mod.Linear("lon"),
                                                   gam_mod.Factor("yrs")], group="species", link="logit")
    rows = []
    for g, f in fits.items():
        c = f.presence.coefficients()
        c.insert(0, "species", g)
        c.insert(1, "part", "presence")
        rows.append(c)
        rows.append(pd.DataFrame([{"species": g, "part": "count", "term": "(Intercept)", "estimate": f.log_lambda,
                                   "se": f.se_log_lambda, "z": f.log_lambda / f.se_log_lambda}]))
    return spark.createDataFrame(pd.concat(rows, ignore_index=True))


@query("year_index_glm")
def q_year_index_glm(spark, d):
    """E5: year index from a categorical presence GLM (inverse logit of intercept + year
    effect + sum over the other factors of their mean effect), per species (rows-only; the
    arithmetic is oracle-checked by ``year_index_effects``)."""
    m = derive.with_classes(index_plan.model_frame(spark, d), hour=None)
    long = m.select("shot_id", "yrs", "season", "vessel", *index_plan.SPECIES).unpivot(
        ["shot_id", "yrs", "season", "vessel"], index_plan.SPECIES, "species", "n").withColumn(
        "p", (F.col("n") > 0).cast("double"))
    fits = gam_mod.fit_gam(long, "p", [gam_mod.Factor("yrs"), gam_mod.Factor("season"), gam_mod.Factor("vessel")],
                           family="binomial", link="logit", group="species")
    rows = []
    for f in fits:
        c = dict(f.coefficients()[["term", "estimate"]].itertuples(index=False))
        rows.append((f.group, "(Intercept)", "", float(c["(Intercept)"])))
        rows += [(f.group, t.col, lv, float(c.get(f"{t.col}{lv}", 0.0))) for t in f.design.terms for lv in t.levels]
    effects_ = spark.createDataFrame(rows, "species string, factor string, level string, estimate double")
    return glm_mod.categorical_year_index(effects_, "yrs", ["species"])


@query("year_index_effects")
def q_year_index_effects(spark, d):
    """E5's arithmetic on effects read off the shots: log odds of narrow presence overall, and
    each year's, season's and vessel's difference from its factor's first level."""
    k = derive.with_classes(_known(spark, d), hour=None).withColumn("yrs", F.col("yr").cast("string"))
    pos = F.sum((F.col("narrow") > 0).cast("long"))
    odds = F.log((pos + 0.5) / (F.count("narrow") - pos + 0.5))
    levels = (k.select("narrow", F.explode(F.create_map(*[x for f in ("yrs", "season", "vessel") for x in (F.lit(f), F.col(f))]))
                       .alias("factor", "level")).dropna().groupBy("factor", "level").agg(odds.alias("odds")))
    first = levels.groupBy("factor").agg(F.min_by("odds", "level").alias("base"))
    diff = levels.join(first, "factor").select("factor", "level", (F.col("odds") - F.col("base")).alias("estimate"))
    base = k.agg(odds.alias("estimate")).select(F.lit("(Intercept)").alias("factor"), F.lit("").alias("level"), "estimate")
    return glm_mod.categorical_year_index(diff.unionByName(base), "yrs")


# --------------------------------------------------------------------------- step 8: remaining learners
from ..models import discriminant  # noqa: E402


@query("firth_glm")
def q_firth_glm(spark, d):
    """Bias-reduced (Firth) logistic presence model per species: year + vessel factors,
    finite even for vessels without any presence (rows-only)."""
    import pandas as pd
    m = index_plan.model_frame(spark, d)
    long = m.select("shot_id", "yrs", "vessel", "hrs", *index_plan.SPECIES).unpivot(
        ["shot_id", "yrs", "vessel", "hrs"], index_plan.SPECIES, "species", "n").withColumn(
        "p", (F.col("n") > 0).cast("double"))
    fits = gam_mod.fit_gam(long, "p", [gam_mod.Linear("hrs"), gam_mod.Factor("yrs"), gam_mod.Factor("vessel")],
                           family="binomial", link="logit", group="species", firth=True, factor_ridge=0.0)
    frames = []
    for f in fits:
        c = f.coefficients()
        c.insert(0, "species", f.group)
        c["converged"] = bool(f.converged)
        frames.append(c)
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))


def _scaled_presence(spark, d):
    cols = ["hrs", "lon", "lat", "mn"]
    k = _model_frame(spark, d).withColumn("label", (F.col("narrow") > 0).cast("double"))
    ensure_checkpoint_dir(spark)
    k = k.select("shot_id", "label", *cols).checkpoint(eager=True)  # read by every pass of the split and the scales
    k = sampling.stratified_split(k, ["label"], "shot_id", 0.7, 666)
    return features.centre_scale(k, cols), cols


@query("lda")
def q_lda(spark, d):
    """G13 + M7: two-class LDA on scaled covariates, held-out AUC (rows-only)."""
    k, cols = _scaled_presence(spark, d)
    fit = discriminant.fit_lda(k.filter(F.col("split") == "train"), "label", cols)
    s = fit.score(k.filter(F.col("split") == "test"))
    return evaluate.auc(s, "label", "lda_score")


@query("rbf_svm")
def q_rbf_svm(spark, d):
    """G14 + M9: radial SVM via 100 random Fourier features + LinearSVC, held-out AUC (rows-only)."""
    k, cols = _scaled_presence(spark, d)
    k = k.checkpoint(eager=True)
    model, tf = discriminant.fit_rbf_svm(k.filter(F.col("split") == "train"), "label", cols, 100, 0.5)
    p = classify.positive_score(model.transform(tf(k.filter(F.col("split") == "test"))))
    return evaluate.auc(p, "label", "score")


from ..models import mixed  # noqa: E402


def _lmm_frame(spark, d):
    m = derive.with_classes(index_plan.model_frame(spark, d), hour=None)
    pos_cap = m.filter((F.col("narrow") + F.col("green")) > 0).agg(F.max("hrs").alias("__cap"))
    m = m.crossJoin(F.broadcast(pos_cap)).filter(F.col("hrs") <= F.col("__cap")).drop("__cap")
    return m.withColumn("presence", (F.col("narrow") > 0).cast("double"))


LMM_TERMS = [gam_mod.Factor("season"), gam_mod.Linear("lon"), gam_mod.Linear("depth"),
             gam_mod.Linear("total_catch"), gam_mod.Linear("hrs")]


@query("lmm_vessel")
def q_lmm_vessel(spark, d):
    """Narrow presence ~ season + lon + depth + total catch + hours + (1 | vessel), REML (rows-only)."""
    import pandas as pd
    fit = mixed.fit_random_intercept(_lmm_frame(spark, d), "presence", LMM_TERMS, "vessel")
    c = fit.coefficients()
    vc = pd.DataFrame([{"term": "sigma2_vessel", "estimate": fit.sigma2_group, "se": float("nan"), "t": float("nan")},
                       {"term": "sigma2_residual", "estimate": fit.sigma2, "se": float("nan"), "t": float("nan")}])
    return spark.createDataFrame(pd.concat([c, vc], ignore_index=True))


@query("lmm_effects")
def q_lmm_effects(spark, d):
    """Mixed-model predictions ±SE over effort for each season, other terms at the
    modal level / mean, modal vessel's random intercept included (rows-only)."""
    m = _lmm_frame(spark, d)
    fit = mixed.fit_random_intercept(m, "presence", LMM_TERMS, "vessel")
    grid = effects.prediction_grid(m, {"hrs": 0.5}, ["season", "vessel"], ["lon", "depth", "total_catch", "hrs"],
                                   "modal")
    seasons = m.select("season").dropna().distinct()
    grid = grid.drop("season").crossJoin(F.broadcast(seasons))     # season levels: two rows
    pred = mixed.predict_mixed(fit, grid, "vessel")
    return pred.select("season", "hrs", "vessel", "pred", "se",
                       (F.col("pred") - F.lit(1.96) * F.col("se")).alias("low"),
                       (F.col("pred") + F.lit(1.96) * F.col("se")).alias("up"))


@query("emmeans_season")
def q_emmeans_season(spark, d):
    """Estimated marginal means of presence by season from a binomial GLM on the
    response scale (rows-only)."""
    m = _fit_frame(spark, d).withColumn(
        "label", (F.col("narrow") > 0).cast("double")).withColumn("yrs", F.col("yr").cast("string"))
    fit = gam_mod.fit_gam(m, "label", [gam_mod.Factor("season"), gam_mod.Factor("yrs"), gam_mod.Linear("hrs"),
                                       gam_mod.Linear("lon")], family="binomial", link="logit")[0]
    ref = m.agg(F.avg("hrs").alias("hrs"), F.avg("lon").alias("lon"))
    return effects.emmeans(fit, ref, "season", ["season", "yrs"], "logit")


from ..models import zip_mixture  # noqa: E402


@query("zip_glm")
def q_zip_glm(spark, d):
    """Zero-inflated Poisson GLM per species, count ~ year factor | zero ~ month (rows-only)."""
    import pandas as pd
    m = index_plan.model_frame(spark, d)
    long = index_plan.long_frame(m)
    fits = zip_mixture.fit_zip(long, "n", [gam_mod.Factor("yrs")], [gam_mod.Linear("mn")], group="species")
    frames = []
    for g, f in fits.items():
        c = f.coefficients()
        c.insert(0, "species", g)
        c["loglik"] = f.loglik
        c["converged"] = f.converged
        frames.append(c)
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))



@query("zinb_glm")
def q_zinb_glm(spark, d):
    """Zero-inflated negative-binomial GLM per species, count ~ month | zero ~ month, with θ (rows-only)."""
    import pandas as pd
    long = index_plan.long_frame(index_plan.model_frame(spark, d))
    fits = zip_mixture.fit_zip(long, "n", [gam_mod.Linear("mn")], [gam_mod.Linear("mn")], group="species", family="negbin")
    frames = []
    for g, f in fits.items():
        c = f.coefficients()
        c.insert(0, "species", g)
        c["theta"], c["loglik"], c["iterations"], c["converged"] = f.theta, f.loglik, f.iterations, f.converged
        frames.append(c)
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))


from ..operators import smote as smote_op  # noqa: E402


@query("smote_balance")
def q_smote_balance(spark, d):
    """Q6: SMOTE (perc.over 100, perc.under 200, k 5) of narrow presence on the model
    frame; class sizes and feature means of the balanced data (rows-only)."""
    m = derive.with_classes(index_plan.model_frame(spark, d), hour=None)
    m = m.select("shot_id", "yrs", "season", "vessel", "hrs", "lat", "lon", "depth", "mn",
                 F.col("narrow").cast("double").alias("n"), (F.col("narrow") > 0).cast("int").alias("presence"))
    out = smote_op.smote(m, "presence", "shot_id", ["n", "hrs", "lat", "lon", "depth", "mn"],
                         ["yrs", "season", "vessel"], 100, 200, k=5, seed=666)
    return out.groupBy("presence", "synthetic").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("hrs").alias("mean_hrs"), F.avg("lon").alias("mean_lon"),
        F.avg("n").alias("mean_n"), F.count_distinct("vessel").alias("vessels"))


# --------------------------------------------------------------------------- boosted trees (G10, G11) and all presence models
from ..models import boost  # noqa: E402

PRESENCE_FACTORS = ["yrs", "season", "vessel", "day_night"]
PRESENCE_NUMERIC = ["hrs", "lat", "lon", "depth", "mn", "start_hour"]


def _presence_long(spark, d):
    """One row per (species, shot) that models are fitted to, with all predictors and ``presence``."""
    m = derive.with_classes(index_plan.model_frame(spark, d))
    keep = ["shot_id", *PRESENCE_FACTORS, *PRESENCE_NUMERIC]
    return m.select(*keep, *SPECIES).unpivot(keep, SPECIES, "species", "n").withColumn("presence", (F.col("n") > 0).cast("int"))


def _with_folds(long, repeats):
    """A column of stratified folds 1..10 for each repeat."""
    per = sampling.cv_folds(long.select("species", "presence", "shot_id"), ["species", "presence"], "shot_id", 10, repeats, 666)
    wide = per.groupBy("species", "shot_id").agg(*[F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(f"fold{r}")
                                                   for r in range(1, repeats + 1)])
    return long.join(wide, ["species", "shot_id"])


def _split_long(spark, d):
    """``_presence_long`` with the 70/30 split of each species and class, written once."""
    return sampling.stratified_split(_presence_long(spark, d), ["species", "presence"], "shot_id", 0.7, 666).checkpoint(eager=True)


@query("boosted_cv")
def q_boosted_cv(spark, d):
    """G11 + M11: boosted trees of the 70 % part of each species over tree size x number of trees,
    10 folds x 3 repeats: held-out AUC of every cell (mean, sd, quartiles), and the best cell (rows-only)."""
    train = _split_long(spark, d).filter(F.col("split") == "train")
    folds = _with_folds(train, 3).checkpoint(eager=True)
    aucs, _ = boost.tune(folds, "shot_id", "species", "presence", PRESENCE_NUMERIC, PRESENCE_FACTORS, ["fold1", "fold2", "fold3"], 10)
    aucs = aucs.checkpoint(eager=True)
    cells = boost.chosen(aucs).join(evaluate.resample_summary(aucs, ["group", "size", "trees"], ["auc"]), ["group", "size", "trees"])
    return cells.drop("auc_mean").withColumnRenamed("group", "species")


@query("boosted_grown")
def q_boosted_grown(spark, d):
    """Trees of five splits at rate 0.01 on shots under 6 h, grown by 50 until the ten folds'
    held-out deviance falls no more: the deviance curve of each species, where it stopped and the
    chosen number of trees (rows-only)."""
    long = _with_folds(_presence_long(spark, d).filter(F.col("hrs") < 6), 1).checkpoint(eager=True)
    curve, _ = boost.grown(long, "shot_id", "species", "presence", PRESENCE_NUMERIC, PRESENCE_FACTORS, "fold1")
    return spark.createDataFrame(curve.rename(columns={"group": "species"}))


@query("boosted_dependence")
def q_boosted_dependence(spark, d):
    """E6 + E3 + M12: boosted trees of five splits at rate 0.01 on shots under 6 h, 100 trees a species, each on the
    gradient that the trees before it leave: partial dependence on effort (20 values) and on day or night, centred on the link scale, with the
    predictor's share of the gain (rows-only)."""
    long = _presence_long(spark, d).filter(F.col("hrs") < 6).checkpoint(eager=True)
    fit = boost.Fit(long, "shot_id", "species", "presence", PRESENCE_NUMERIC, PRESENCE_FACTORS, [boost.Ensemble(s, 5) for s in SPECIES],
                    rate=0.01)
    fit.grow(100)
    parts = []
    for model in fit.fitted():
        own, share = long.filter(F.col("species") == model.of.group), model.importance()
        for term in ("hrs", "day_night"):
            effect = effects.partial_dependence(own, model, term)
            parts.append(effects.centre_effect(effect, [], "pd_link").select(
                F.lit(model.of.group).alias("species"), F.lit(term).alias("term"), F.col(term).cast("string").alias("value"),
                "pd_link", F.lit(share[term]).alias("gain_share")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _smoted(spark, train):
    """SMOTE of each species' training rows (perc.over 100, perc.under 200, k 5) with new row ids."""
    parts = []
    for species in SPECIES:
        own = train.filter(F.col("species") == species).withColumn("n", F.col("n").cast("double")).drop("split")
        own = own.withColumns({c: F.col(c).cast("double") for c in PRESENCE_NUMERIC})
        made = smote_op.smote(own, "presence", "shot_id", [*PRESENCE_NUMERIC, "n"], PRESENCE_FACTORS, 100, 200, k=5, seed=666)
        parts.append(made.withColumn("shot_id", F.xxhash64("shot_id", "draw")).drop("draw", "synthetic"))
    return parts[0].unionByName(parts[1]).checkpoint(eager=True)


@query("presence_models")
def q_presence_models(spark, d):
    """G1, G2, G11, Q6 + M8-M10: presence models of both species on the 70 % part, binomial (effort as
    offset) and tuned boosted trees also on its SMOTE, bias-reduced binomial on the part itself:
    AUC and confusion at 0.5 on the 30 % (rows-only)."""
    long = _split_long(spark, d)
    train, test = long.filter(F.col("split") == "train"), long.filter(F.col("split") == "test")
    smoted = _smoted(spark, train)
    terms = [*[gam_mod.Factor(f) for f in PRESENCE_FACTORS], gam_mod.Linear("lon"), gam_mod.Linear("depth")]
    scored = []

    def keep(name, frame):
        scored.append(frame.select("species", F.lit(name).alias("model"), F.col("presence").alias("label"), "score"))

    # the bias-reduced fit starts from the presence rate alone: with an offset, zeros are too far
    rate = train.groupBy("species").agg(F.avg("presence").alias("p"), F.avg("hrs").alias("hrs")).collect()
    begin = {r["species"]: math.log(r["p"] / (1 - r["p"])) - r["hrs"] for r in rate}
    start = None
    for name, rows, firth in (("binomial", train, False), ("binomial_smote", smoted, False), ("binomial_firth", train, True)):
        fits = gam_mod.fit_gam(rows.withColumn("p", F.col("presence").cast("double")), "p", terms, family="binomial", link="logit",
                               group="species", offset="hrs", firth=firth, start=start if firth else None)
        start = start or {f.group: [begin[f.group]] + [0.0] * (f.design.p - 1) for f in fits}
        linear = gam_mod.predict_frame({f.group: f for f in fits}, test, "species", "eta", "se")
        keep(name, linear.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("eta") + F.col("hrs"))))))
    for name, rows in (("boosted", train), ("boosted_smote", smoted)):
        folds = _with_folds(rows, 1).checkpoint(eager=True)  # one repeat chooses the cell; boosted_cv has all three
        aucs, fit = boost.tune(folds, "shot_id", "species", "presence", PRESENCE_NUMERIC, PRESENCE_FACTORS, ["fold1"], 10, batch=10)
        best = {r["group"]: (r["size"], r["trees"]) for r in boost.chosen(aucs).filter("best").collect()}
        models = {m.of.group: boost.Boosted(m.of, m.start, m.trees[:best[m.of.group][1]], m.bins)
                  for m in fit.fitted() if not m.of.repeat and m.of.size == best[m.of.group][0]}
        keep(name, boost.score(test, models, "species"))
    scores = scored[0]
    for s in scored[1:]:
        scores = scores.unionByName(s)
    scores = scores.checkpoint(eager=True)
    by = ["species", "model"]
    return evaluate.auc(scores, "label", "score", by).join(evaluate.confusion(scores, "label", "score", 0.5, by), by)


# --------------------------------------------------------------------------- sort / limit / reshape rows
@query("distinct_years")
def q_distinct_years(spark, d):
    """O1 + O2: distinct sorted years with positive narrow catch."""
    return _known(spark, d).filter(F.col("narrow") > 0).select("yr").distinct().orderBy("yr")


@query("climatology_head")
def q_climatology_head(spark, d):
    """O3: first six rows of the year × month climatology in (year, month) order."""
    return enrich.climatology(tables.sst(spark, d), by=["yr", "mn"]).orderBy("yr", "mn").limit(6)


@query("interactions_by_hour")
def q_interactions_by_hour(spark, d):
    """Interactions (summed counts of positive shots) by hour of day per species."""
    h = clean.min_effort(tables.shots_hourly(spark, d))
    long = h.select("start_hour", "narrow", "green").unpivot(["start_hour"], ["narrow", "green"], "species", "k")
    return (long.filter(F.col("k") > 0).groupBy("species", "start_hour")
            .agg(F.sum("k").cast("bigint").alias("interactions")))


@query("coefficients_wide")
def q_coefficients_wide(spark, d):
    """U2 + P23 + P25: presence-GLM coefficients bound by term across species (one column
    per species), with odds ratios and p-value text (rows-only)."""
    m = _fit_frame(spark, d).withColumn("yrs", F.col("yr").cast("string"))
    long = m.select("shot_id", "yrs", "season", "hrs", *SPECIES).unpivot(
        ["shot_id", "yrs", "season", "hrs"], SPECIES, "species", "n").withColumn("p", (F.col("n") > 0).cast("double"))
    fits = gam_mod.fit_gam(long, "p", [gam_mod.Factor("yrs"), gam_mod.Factor("season"), gam_mod.Linear("hrs")],
                           family="binomial", link="logit", group="species")
    import pandas as pd
    from ..functions.distributions import norm_sf_scalar
    from ..functions.links import format_p
    frames = []
    for f in fits:
        c = f.coefficients()
        c["species"] = f.group
        c["p_value"] = [2 * norm_sf_scalar(abs(z)) for z in c["z"]]
        frames.append(c)
    long_c = spark.createDataFrame(pd.concat(frames, ignore_index=True))
    long_c = long_c.withColumns({"odds_ratio": F.exp("estimate"), "p_text": format_p("p_value")})
    est = long_c.groupBy("term").pivot("species", SPECIES).agg(F.first("estimate"))
    txt = long_c.groupBy("term").pivot("species", SPECIES).agg(F.first("p_text"))
    return est.join(txt.select("term", *[F.col(s).alias(f"{s}_p") for s in SPECIES]), "term")


@query("boot_index_poisson")
def q_boot_index_poisson(spark, d):
    """G18 + M5 (scalable variant): 20 Poisson-bootstrap refits of the hurdle index fitted in
    the same passes, percentile bands (rows-only)."""
    return index_plan.boot_index(spark, d, 20, 666, method="poisson")


# --------------------------------------------------------------------------- streaming
from ..streaming import logbook_stream  # noqa: E402


@query("boot_index_exact")
def q_boot_index_exact(spark, d):
    """G18 + M5: 100 bootstrap refits of exact year sizes without copies, smoothing re-estimated in
    each; percentile bands and the number of failed replicates (rows-only)."""
    return index_plan.boot_index(spark, d, 100, 666, method="exact")


@query("stream_nominal_cpue")
def q_stream_nominal_cpue(spark, d):
    """Streaming ingestion: the shots rendered as shot-log CSV files, consumed by a
    Structured Streaming query (available-now trigger, checkpoint in the shared folder)
    that keeps per (species, year) sufficient statistics; nominal CPUE derived from the
    state equals the batch flagship."""
    folder = scratch_path(spark, f"stream_in_{_uuid.uuid4().hex}")
    logbook.write_shot_log_csv(tables.shots(spark, d), folder)
    name = f"cpue_state_{_uuid.uuid4().hex[:12]}"
    q = logbook_stream.start_cpue_stream(spark, folder, name,
                                         checkpoint=scratch_path(spark, f"stream_ckpt_{name}"), trigger_once=True)
    q.awaitTermination()
    return logbook_stream.cpue_from_state(spark.table(name))


@query("imputed_join")
def q_imputed_join(spark, d):
    """Values imputed in a separate table keyed (shot, start lat, start lon) — depth
    filled by its 0.1° cell mean — joined back null-safely on the composite key;
    summary by whether depth was missing."""
    k = _known(spark, d)
    cells = k.select("shot_id", "slat", "slong", "depth",
                     N.trunc_tenth("slat").alias("cl"), N.trunc_tenth("slong").alias("cn"))
    means = cells.groupBy("cl", "cn").agg(F.avg("depth").alias("__m"))
    imputed = (cells.join(means, on=["cl", "cn"], how="left")
               .select("shot_id", "slat", "slong", F.coalesce("depth", "__m").alias("depth_imp")))
    j = enrich.join_imputed(k.select("shot_id", "slat", "slong", "depth"), imputed, ["shot_id", "slat", "slong"],
                            "depth_imp")
    return j.groupBy(F.col("depth").isNull().alias("was_missing")).agg(
        F.count(F.lit(1)).alias("shots"), F.count("depth_imp").alias("filled"), F.avg("depth_imp").alias("mean_depth"))


@query("index_scaled")
def q_index_scaled(spark, d):
    """W2 + W3: the hurdle index per species and term both relative to its series mean and
    per 1000 trawled hours (rows-only)."""
    idx = index_plan.zip_index(spark, d)
    rel = summarise.relative_index(idx, ["species", "term"], ["mean", "low", "up"])
    rel = rel.select("species", "term", "x", *[F.col(c).alias(f"{c}_rel") for c in ["mean", "low", "up"]])
    per = summarise.scale_per(idx, ["mean", "low", "up"], 1000.0).select(
        "species", "term", "x", *[F.col(c).alias(f"{c}_per_1000h") for c in ["mean", "low", "up"]])
    return rel.join(per, on=["species", "term", "x"], how="inner")


@query("chisq_pvalue")
def q_chisq_pvalue(spark, d):
    """χ² statistic, degrees of freedom and upper-tail p-value of interactions vs shots
    over the effort bins (rows-only; the oracle-checked twin omits the p-value)."""
    b = bins.effort_bins(_model_frame(spark, d))
    return describe.chisq_contingency(b, "interactions", "shots")


# --------------------------------------------------------------------------- recodes, flags, links and summaries on their own
from ..functions import links  # noqa: E402
from ..models import bootstrap as bootstrap_mod  # noqa: E402


@query("vessel_recode")
def q_vessel_recode(spark, d):
    """Vessel names with listed values replaced, exact matches only; shots per name."""
    s = derive.recode(_prepared(spark, d), "vessel", {"Vessel 2 II": "Vessel 2", "VESSEL 3": "Vessel 3", "vessel 4": "never"})
    return s.groupBy("vessel").agg(F.count(F.lit(1)).alias("shots"))


@query("missing_depth")
def q_missing_depth(spark, d):
    """P14 + F7: shots with and without a depth per season, and those that a cut at 100 m keeps (missing ones go)."""
    k = derive.with_classes(_known(spark, d), hour=None).withColumn("depth_missing", C.missing_flag("depth"))
    kept = clean.depth_cut(k, maximum=100.0).groupBy("season", "depth_missing").agg(F.count(F.lit(1)).alias("kept"))
    return (k.groupBy("season", "depth_missing").agg(F.count(F.lit(1)).alias("shots"))
            .join(kept, ["season", "depth_missing"], "left").withColumn("kept", F.coalesce("kept", F.lit(0))))


@query("presence_odds")
def q_presence_odds(spark, d):
    """P23 + P24 + P25: presence odds per vessel and their ratio to the first vessel's, the share through
    the inverse links, and the share cubed as p-value text."""
    k = derive.normalise_vessel(_known(spark, d), "vessel", ADAPTER_VESSEL_ALIASES)
    t = k.groupBy("vessel").agg(((F.sum((F.col("narrow") > 0).cast("int")) + 0.5) / (F.count(F.lit(1)) + 1.0)).alias("p"))
    t = t.withColumn("odds", links.odds("p"))
    first = t.agg(F.min_by("odds", "vessel").alias("base"))  # one row
    t = t.crossJoin(F.broadcast(first)).withColumn("odds_ratio", F.col("odds") / F.col("base")).drop("base")
    return t.withColumns({"by_logit": links.inv_logit(F.log("odds")), "by_cloglog": links.inv_cloglog(F.log("p")),
                          "p_text": links.format_p(F.col("p") * F.col("p") * F.col("p"))})


@query("rate_per_1000h")
def q_rate_per_1000h(spark, d):
    """Annual catch per hour of both species expressed per 1,000 hours."""
    t = _known(spark, d).groupBy("yr").agg(*[(F.sum(c) / F.sum("hrs")).alias(c) for c in SPECIES])
    return summarise.scale_per(t, SPECIES)


@query("factor_codes")
def q_factor_codes(spark, d):
    """Q3: levels of season and effort class as treatment codes: place in alphabetical order, and the
    one-hot slots left when the first level is the reference; shots per pair."""
    from pyspark.ml.functions import vector_to_array
    k = derive.with_classes(_known(spark, d), hour=None).select("season", "effort_class").dropna()
    e, _ = features.encode_factors(k, ["season", "effort_class"])
    e = e.withColumns({f: F.concat_ws(",", F.transform(vector_to_array(f"{f}_vec"), lambda v: v.cast("int").cast("string")))
                       for f in ("season", "effort_class")} | {f"{f}_level": F.col(f) for f in ("season", "effort_class")})
    return e.groupBy("season_level", "effort_class_level", F.col("season_idx").cast("int").alias("season_idx"),
                     F.col("effort_class_idx").cast("int").alias("effort_class_idx"), F.col("season").alias("season_code"),
                     F.col("effort_class").alias("effort_class_code")).agg(F.count(F.lit(1)).alias("shots"))


@query("boot_rate_band")
def q_boot_rate_band(spark, d):
    """M5 + Q7: nominal catch per hour of each species in 5 stratified bootstrap replicates: median, sd,
    CV and 2.5 and 97.5 percentiles."""
    k = _known(spark, d)
    drawn = sampling.bootstrap_counts(k, ["yr"], "shot_id", 5, 666).select("replicate", "shot_id", "count")
    long = k.select("shot_id", "hrs", *SPECIES).unpivot(["shot_id", "hrs"], SPECIES, "species", "n")
    per = long.join(drawn, "shot_id").groupBy("species", "replicate").agg(
        (F.sum(F.col("n") * F.col("count")) / F.sum(F.col("hrs") * F.col("count"))).alias("mean"))
    return bootstrap_mod.summarise_replicates(per, ["species"])


@query("sst_csv")
def q_sst_csv(spark, d):
    """S2 + S4 + A2: temperatures written as the source's CSV, read back with its schema, month climatology."""
    path = scratch_path(spark, f"sst_{_uuid.uuid4().hex}")
    files.write_csv(tables.sst(spark, d).select(F.col("lat").alias("Lat"), F.col("lon").alias("Long"), F.col("yr").alias("year"),
                                                F.col("mn").alias("month"), "value"), path)
    back = files.read_sst(spark, path).withColumnsRenamed({"Lat": "lat", "Long": "lon", "year": "yr", "month": "mn"})
    return enrich.climatology(back)


@query("year_tables")
def q_year_tables(spark, d):
    """S5 + A16: shots written as a table partitioned by year; the catch of three years read from their partitions."""
    path = scratch_path(spark, f"years_{_uuid.uuid4().hex}")
    files.write_table(_known(spark, d).select("yr", "narrow", "green", "hrs"), path, partition_by=["yr"])
    back = spark.read.parquet(path).filter(F.col("yr").between(1994, 1996))
    return back.groupBy(F.col("yr").cast("int").alias("yr")).agg(
        F.sum("narrow").cast("bigint").alias("narrow"), F.sum("green").cast("bigint").alias("green"), F.sum("hrs").alias("hrs"))


@query("rate_bands")
def q_rate_bands(spark, d):
    """F8: per species and year, shots with a catch, and those whose catch per hour lies inside (0, 0.4) with their mean rate."""
    long = _known(spark, d).select("shot_id", "yr", "hrs", *SPECIES).unpivot(["shot_id", "yr", "hrs"], SPECIES, "species", "n")
    long = clean.positive(long, "n").withColumn("rate", F.col("n") / F.col("hrs"))
    inside = clean.rate_band(long, "rate", 0.0, 0.4).groupBy("species", "yr").agg(F.count(F.lit(1)).alias("inside"), F.avg("rate").alias("mean_rate"))
    return (long.groupBy("species", "yr").agg(F.count(F.lit(1)).alias("positive"))
            .join(inside, ["species", "yr"], "left").withColumn("inside", F.coalesce("inside", F.lit(0))))


# --------------------------------------------------------------------------- both species: deviance with the offset, grids, dispersion
@query("presence_anova")
def q_presence_anova(spark, d):
    """G1 + M13: sequential analysis of deviance of both species' presence on year, season, vessel, day or
    night, longitude and depth, with effort as offset (rows-only)."""
    long = _presence_long(spark, d).withColumn("p", F.col("presence").cast("double")).checkpoint(eager=True)
    terms = [*[gam_mod.Factor(f) for f in PRESENCE_FACTORS], gam_mod.Linear("lon"), gam_mod.Linear("depth")]
    return spark.createDataFrame(glm_mod.grouped_anova(long, "p", terms, "species", offset="hrs"))


@query("prediction_grid")
def q_prediction_grid(spark, d):
    """Q9 + A28: levels of year and season and 0.5 h steps of effort, each with the other columns at the
    reference profile, once with the rarest and once with the most common levels."""
    k = derive.with_classes(_known(spark, d), hour=None).withColumn("yrs", F.col("yr").cast("string"))
    grids = [effects.prediction_grid(k, {"yrs": None, "season": None, "hrs": 0.5}, ["yrs", "season", "vessel"], ["lon", "hrs"], level)
             .withColumn("reference", F.lit(level)) for level in ("rarest", "modal")]
    return grids[0].unionByName(grids[1])


@query("dispersion_about_means")
def q_dispersion_about_means(spark, d):
    """Dispersion of each species' counts about the means of its years, with the test's z; years without
    any catch have a mean of 0, about which no dispersion is defined."""
    long = _known(spark, d).select("yr", *SPECIES).unpivot(["yr"], SPECIES, "species", "n")
    mean = long.groupBy("species", "yr").agg(F.avg("n").alias("mu")).filter("mu > 0")
    return zeroinfl.overdispersion(long.join(mean, ["species", "yr"]), "n", "mu", ["species"])
