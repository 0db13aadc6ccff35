"""Catch, effort and catch-rate summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import derive

Z95 = 1.96  # fixed: normal quantile used for 95 % intervals


def nominal_cpue(df: DataFrame, species: list[str] | None = None, yr: str = "yr",
                 hours: str = "hrs", scaler: float = 1000.0) -> DataFrame:
    """A1: mean catch per ``scaler`` hours by species and year with a normal 95 % CI.

    One long result with a ``species`` column: the wide species columns are
    unpivoted before the aggregate, so both species share one scan and one shuffle
    (partial aggregation map-side, final by (species, year)).
    """
    species = species or list(derive.SPECIES)
    long = df.select(yr, hours, *species).unpivot([yr, hours], species, "species", "__n")
    rate = (F.lit(float(scaler)) * F.col("__n") / F.col(hours)).alias("cpue")
    g = (long.select("species", yr, rate).groupBy("species", yr)
         .agg(F.avg("cpue").alias("mean"), F.count(F.lit(1)).alias("n"),
              F.stddev_samp("cpue").alias("sd")))
    half = F.lit(Z95) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return g.withColumns({"low_cl": F.col("mean") - half, "upp_cl": F.col("mean") + half})


def _species_long(df: DataFrame, keep: list[str], species: list[str], value: str = "n") -> DataFrame:
    return df.select(*keep, *species).unpivot(keep, species, "species", value)


def catch_effort_profile(df: DataFrame, dims: dict[str, F.Column | str], species: list[str] | None = None,
                         hours: str = "hrs", measure_name: str = "hrs") -> DataFrame:
    """Catch, effort (hours) and shots per level of each dimension, in ONE scan.

    ``dims`` maps a dimension name to a column (month, hour, 10 m depth bin, ...).
    All dimensions are computed as grouping sets of one aggregate; per species the
    effort and shot series are kept only at levels where that species was caught
    (T22, the semi-join of the reference expressed as ``positive_shots > 0``).
    Null levels are dropped (formula NA rule). ``hours``/``measure_name`` may name
    another summed measure, e.g. landings in tonnes (A9).
    """
    species = species or list(derive.SPECIES)
    names = list(dims)
    base = df.select(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for n, c in dims.items()],
                     F.col(hours).alias("__h"), *species)
    aggs = [F.sum("__h").alias(measure_name), F.count(F.lit(1)).alias("shots")]
    for s in species:
        aggs += [F.sum(F.when(F.col(s) > 0, F.col(s)).otherwise(F.lit(0))).cast("bigint").alias(f"__c_{s}"),
                 F.sum(F.when(F.col(s) > 0, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias(f"__p_{s}")]
    g = base.groupingSets([[n] for n in names], *names).agg(
        F.grouping_id(*names).alias("__gid"), *aggs)
    # grouping_id bit for dimension i (leftmost = most significant) is 0 when grouped on it
    nd = len(names)
    dim_name = F.lit(None).cast("string")
    level = F.lit(None).cast("double")
    for i, n in enumerate(names):
        only_i = (1 << nd) - 1 - (1 << (nd - 1 - i))
        dim_name = F.when(F.col("__gid") == only_i, F.lit(n)).otherwise(dim_name)
        level = F.when(F.col("__gid") == only_i, F.col(n)).otherwise(level)
    g = g.select(dim_name.alias("dimension"), level.alias("level"), measure_name, "shots",
                 *[F.col(f"__c_{s}") for s in species], *[F.col(f"__p_{s}") for s in species])
    per = [F.struct(F.lit(s).alias("species"), F.col(f"__c_{s}").alias("catch"),
                    F.col(f"__p_{s}").alias("positive_shots")) for s in species]
    out = (g.filter(F.col("level").isNotNull())
           .select("dimension", "level", measure_name, "shots", F.explode(F.array(*per)).alias("__s"))
           .select("__s.species", "dimension", "level", "__s.catch", "__s.positive_shots", measure_name, "shots"))
    return out.filter(F.col("positive_shots") > 0)


def mean_by_dims(df: DataFrame, dims: dict[str, F.Column | str], value: F.Column | str, name: str = "mean") -> DataFrame:
    """Mean of a value per level of several dimensions in one grouping-sets pass (long)."""
    names = list(dims)
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for n, c in dims.items()],
                     v.alias("__v"))
    g = base.groupingSets([[n] for n in names], *names).agg(
        F.grouping_id(*names).alias("__gid"), F.avg("__v").alias(name), F.count("__v").alias("n"))
    nd = len(names)
    dim_name, level = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, n in enumerate(names):
        only_i = (1 << nd) - 1 - (1 << (nd - 1 - i))
        dim_name = F.when(F.col("__gid") == only_i, F.lit(n)).otherwise(dim_name)
        level = F.when(F.col("__gid") == only_i, F.col(n)).otherwise(level)
    return (g.select(dim_name.alias("dimension"), level.alias("level"), name, "n")
            .filter(F.col("level").isNotNull() & (F.col("n") > 0)))


def catch_frequency(df: DataFrame, species: list[str] | None = None) -> DataFrame:
    """A13 + W1: records per number caught among positive shots, and % of the species' total."""
    species = species or list(derive.SPECIES)
    long = _species_long(df, [], species, "n_caught").filter(F.col("n_caught") > 0)
    t = long.groupBy("species", "n_caught").agg(F.count(F.lit(1)).alias("records"))
    # the window runs over the tallied table (one row per species and count value), never raw rows
    w = Window.partitionBy("species")
    return t.withColumn("percent", F.bround(F.lit(100.0) * F.col("records") / F.sum("records").over(w), 2))


def count_distribution(df: DataFrame, species: list[str] | None = None) -> DataFrame:
    """Records per number caught, zeros included, per species."""
    species = species or list(derive.SPECIES)
    return (_species_long(df, [], species, "n_caught").groupBy("species", "n_caught")
            .agg(F.count(F.lit(1)).alias("records")))


def occurrence(df: DataFrame, species: list[str] | None = None) -> DataFrame:
    """% of shots with any catch (3 digits) and with each species (2 digits), one row."""
    species = species or list(derive.SPECIES)
    anyc = F.lit(0)
    for s in species:
        anyc = anyc + F.col(s)
    n = F.count(F.lit(1))
    aggs = [F.bround(F.lit(100.0) * F.sum(F.when(anyc > 0, 1).otherwise(0)) / n, 3).alias("pct_any")]
    aggs += [F.bround(F.lit(100.0) * F.sum(F.when(F.col(s) > 0, 1).otherwise(0)) / n, 2).alias(f"pct_{s}")
             for s in species]
    return df.agg(*aggs)


def table1(df: DataFrame, hours: str = "hrs") -> DataFrame:
    """Grand totals alive/dead per species, records and effort."""
    return df.agg(F.sum("green_alive").cast("bigint").alias("green_alive"),
                  F.sum("green_dead").cast("bigint").alias("green_dead"),
                  F.sum("narrow_alive").cast("bigint").alias("narrow_alive"),
                  F.sum("narrow_dead").cast("bigint").alias("narrow_dead"),
                  F.count(F.lit(1)).alias("records"), F.sum(hours).alias("effort"))


def annual_catch(df: DataFrame, yr: str = "yr") -> DataFrame:
    """alive/dead catch by year for both species."""
    return df.groupBy(yr).agg(*[F.sum(c).cast("bigint").alias(c) for c in
                                ["green_alive", "green_dead", "narrow_alive", "narrow_dead"]])


def annual_effort(df: DataFrame, yr: str = "yr", hours: str = "hrs", scale: float = 1000.0) -> DataFrame:
    """Effort per year in thousands of hours."""
    return df.groupBy(yr).agg((F.sum(hours) / F.lit(scale)).alias("effort_k_hrs"))


def effort_by(df: DataFrame, key: str, hours: str = "hrs") -> DataFrame:
    """A4: rounded (half-even) effort per key, e.g. end month.

    The sum is first rounded to 6 decimals so summation order across partitions
    cannot move a value off an exact .5 tie."""
    return (df.filter(F.col(hours).isNotNull()).groupBy(key)
            .agg(F.bround(F.round(F.sum(hours), 6), 0).alias("effort")))


def catch_map(df: DataFrame, key: str, species: str, lon: str = "lon", lat: str = "lat",
              hours: str = "hrs") -> DataFrame:
    """A5 + J4: catch per (key, lon, lat) split into positive and zero points, with the key's
    rounded effort and a label; the key totals are a small per-key table joined back."""
    pts = df.groupBy(key, lon, lat).agg(F.sum(species).cast("bigint").alias("total"))
    eff = effort_by(df, key, hours)
    return (pts.join(eff, on=key, how="left")
            .withColumn("positive", F.col("total") > 0)
            .withColumn("label", F.concat(F.col(key).cast("string"), F.lit(" ("),
                                          F.col("effort").cast("bigint").cast("string"), F.lit(" trawled h)"))))


def level_catch(df: DataFrame, factors: list[str], species: list[str] | None = None) -> DataFrame:
    """Catch summed by level of each model factor among positive shots, per species (long)."""
    species = species or list(derive.SPECIES)
    long = (df.select(*[F.col(f).cast("string").alias(f) for f in factors], *species)
            .unpivot(factors, species, "species", "__k").filter(F.col("__k") > 0))
    lv = long.unpivot(["species", "__k"], factors, "factor", "level")
    return lv.groupBy("species", "factor", "level").agg(F.sum("__k").cast("bigint").alias("catch"))


def positive_by_level(df: DataFrame, factors: list[str], binned: dict[str, int],
                      species: list[str] | None = None) -> DataFrame:
    """A10: positive shots per predictor level; factors as is, numeric predictors in
    ``n`` equal-width bins over their range (T15). Min/max come from one global
    aggregate (a single row, broadcast)."""
    from ..functions.numeric import cut_equal_width
    species = species or list(derive.SPECIES)
    rng = df.agg(*[F.min(c).alias(f"__lo_{c}") for c in binned], *[F.max(c).alias(f"__hi_{c}") for c in binned])
    d = df.crossJoin(F.broadcast(rng))
    lv = {f: F.col(f).cast("string") for f in factors}
    lv.update({c: cut_equal_width(c, F.col(f"__lo_{c}"), F.col(f"__hi_{c}"), n).cast("string")
               for c, n in binned.items()})
    preds = list(lv)
    d = d.select(*[v.alias(k) for k, v in lv.items()], *species)
    long = d.unpivot(preds, species, "species", "__k").unpivot(["species", "__k"], preds, "predictor", "level")
    return (long.filter(F.col("level").isNotNull()).groupBy("species", "predictor", "level")
            .agg(F.sum(F.when(F.col("__k") > 0, 1).otherwise(0)).cast("bigint").alias("positive")))


def relative_index(idx: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Divide each series (and its band) by the series mean of the first column.

    ``idx`` is a small index table (one row per term value); the window is over it.
    """
    w = Window.partitionBy(*keys)
    m = F.avg(cols[0]).over(w)
    return idx.withColumns({c: F.col(c) / m for c in cols})


def scale_per(idx: DataFrame, cols: list[str], factor: float = 1000.0) -> DataFrame:
    """Express an index per ``factor`` hours."""
    return idx.withColumns({c: F.col(c) * F.lit(float(factor)) for c in cols})


def class_proportions(df: DataFrame, cols: list[str]) -> DataFrame:
    """% of rows per class (one-way for one column, two-way for two)."""
    t = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("percent", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


def panel_rate(df: DataFrame, panel: str, key: list[str], catch: str, hours: str = "hrs") -> DataFrame:
    """Each shot's catch per hour, and its share of the largest rate in its panel.

    The maximum is aggregated and joined back, so a panel of any size is no single task's window."""
    t = df.filter(F.col(hours) > 0).select(panel, *key, (F.col(catch) / F.col(hours)).alias("rate"))
    top = t.groupBy(F.col(panel).alias("__panel")).agg(F.max("rate").alias("__top"))
    return (t.join(top, F.col(panel).eqNullSafe(F.col("__panel")))
            .withColumn("scaled", F.col("rate") / F.col("__top")).drop("__panel", "__top"))
