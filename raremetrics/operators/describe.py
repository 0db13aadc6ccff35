"""Descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, quantile_columns

WHISKER_IQR = 1.5  # fixed: boxplot whisker reach in IQRs
KDE_POINTS = 512   # fixed: evaluation points of a density curve
KDE_CUT = 3.0      # fixed: curve extends this many bandwidths beyond the data range


def percentiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact type-7 quantiles (and range) per group, long (prob, quantile).

    Computed by bucketed order-statistic selection (``quantiles.exact_quantiles``), so a
    group holding most rows is never buffered in one task."""
    by = by or []
    return exact_quantiles(df, value, probs, by).select(*by, "prob", "quantile")


def boxplot_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR) and outlier counts per group.

    Exact quartiles per group by bucketed selection, then the whisker/outlier pass over
    the rows joined to their group's quartiles (one row per group; AQE broadcasts it)."""
    d = df.select(*by, F.col(value).alias("__v")).dropna()
    q = quantile_columns(d, "__v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    lo = F.col("q1") - F.lit(WHISKER_IQR) * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + F.lit(WHISKER_IQR) * (F.col("q3") - F.col("q1"))
    j = d.join(q, on=by, how="inner")
    inside = (F.col("__v") >= lo) & (F.col("__v") <= hi)
    s = j.groupBy(*by).agg(
        F.min(F.when(inside, F.col("__v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("outliers"))
    return q.join(s, on=by, how="inner")


def kde(df: DataFrame, value: str, by: list[str] | None = None, adjust: float = 1.0,
        bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on 512 points per group.

    Bandwidth defaults to Silverman's rule (0.9·min(sd, IQR/1.34)·n^−1/5)·adjust, with
    R's fallback for tied values; a group of one row has no bandwidth and no density.
    The curve is the sum of the kernel over every value, neither binned nor cut at any distance.
    Equal values are counted first; each distinct one then adds to all points of its group inside
    its task (a partial aggregate), so what is shuffled does not depend on the number of values.
    """
    by = by or []
    d = df.select(*by, F.col(value).alias("__v")).dropna()
    st = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.stddev_samp("__v").alias("__sd"),
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    qq = quantile_columns(d, "__v", {"__q1": 0.25, "__q3": 0.75}, by).drop("n")
    st = st.join(qq, on=by, how="inner") if by else st.crossJoin(qq)
    if bandwidth is None:
        iqr = (F.col("__q3") - F.col("__q1")) / F.lit(1.34)
        # R's fallback where the range is 0: the sd, else the size of the (only) value, else 1
        scale = F.coalesce(*[F.when(x > 0, x) for x in (F.least(F.col("__sd"), iqr), F.col("__sd"), F.abs(F.col("__lo")))], F.lit(1.0))
        bw = F.lit(0.9) * scale * F.pow(F.col("__n").cast("double"), F.lit(-0.2)) * F.lit(adjust)
        bw = F.when(F.col("__n") > 1, bw)
    else:
        bw = F.lit(float(bandwidth))
    st = st.select(*by, "__n", bw.alias("bw"), "__lo", "__hi").filter(F.col("bw") > 0)
    st = st.withColumns({"__g0": F.col("__lo") - F.lit(KDE_CUT) * F.col("bw"),
                         "__step": ((F.col("__hi") - F.col("__lo")) + F.lit(2 * KDE_CUT) * F.col("bw"))
                         / F.lit(float(KDE_POINTS - 1))})
    w = d.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__w"))
    j = w.join(st, on=by, how="inner") if by else w.crossJoin(F.broadcast(st))
    e = j.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(KDE_POINTS - 1))))
    x = F.col("__g0") + F.col("point") * F.col("__step")
    z = (x - F.col("__v")) / F.col("bw")
    k = F.col("__w") * F.exp(F.lit(-0.5) * z * z) / (F.col("bw") * F.lit(2.5066282746310002))
    return e.groupBy(*by, "point").agg(F.first(x).alias("x"), (F.sum(k) / F.first("__n")).alias("density"))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair (complete pairs), long form, one aggregate."""
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            aggs.append(F.corr(a, b).alias(f"{a}__{b}"))
    row = df.agg(*aggs)
    pairs = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"{a}__{b}").alias("r"))
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    return row.select(F.explode(F.array(*pairs)).alias("p")).select("p.var1", "p.var2", "p.r")


def level_counts(df: DataFrame, factors: list[str]) -> DataFrame:
    """Counts per level of each factor, long (factor, level, n)."""
    long = df.select(*[F.col(f).cast("string").alias(f) for f in factors]).unpivot([], factors, "factor", "level")
    return long.groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"))


def reference_profile(df: DataFrame, factors: list[str], covariates: list[str],
                      reference_level: str = "rarest") -> DataFrame:
    """Reference level per factor and mean per covariate, long (term, level, value).

    ``rarest`` picks the least frequent level (ties → first level in sort order);
    ``modal`` the most frequent (ties → last level in sort order) (T19).
    """
    cnt = level_counts(df, factors).filter(F.col("level").isNotNull())
    if reference_level == "rarest":
        order = [F.col("n").asc(), F.col("level").asc()]
    else:
        order = [F.col("n").desc(), F.col("level").desc()]
    ranked = cnt.withColumn("__r", F.row_number().over(Window.partitionBy("factor").orderBy(*order)))
    lv = ranked.filter(F.col("__r") == 1).select(F.col("factor").alias("term"), "level",
                                                   F.lit(None).cast("double").alias("value"))
    means = df.agg(*[F.avg(c).alias(c) for c in covariates])
    mv = means.unpivot([], covariates, "term", "value").select(
        "term", F.lit(None).cast("string").alias("level"), "value")
    return lv.unionByName(mv)


def chisq_contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson χ² of the contingency table of two columns' distinct values.

    χ² = n·Σ o²/(r·c) − n over observed cells only, so the table of all value pairs
    (mostly zeros) is never built. One row: statistic, df, n, p_value.
    """
    from ..functions.distributions import chi2_sf
    d = df.select(F.col(a).alias("__a"), F.col(b).alias("__b")).dropna()
    cells = d.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("o"))
    ra = cells.groupBy("__a").agg(F.sum("o").alias("r"))
    cb = cells.groupBy("__b").agg(F.sum("o").alias("c"))
    j = cells.join(ra, "__a").join(cb, "__b")
    s = j.agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("__s"),
              F.sum("o").alias("n"),
              F.count_distinct("__a").alias("__ka"), F.count_distinct("__b").alias("__kb"))
    out = s.select((F.col("n") * F.col("__s") - F.col("n")).alias("statistic"),
                   ((F.col("__ka") - 1) * (F.col("__kb") - 1)).cast("bigint").alias("df"), "n")
    return out.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("df").cast("double")))
