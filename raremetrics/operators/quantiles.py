"""Exact type-7 quantiles per group without gathering a group in one task.

One path for every size:

1. equal values collapse to (group, value, count), aggregated before the shuffle, so ties
   cost one row;
2. those rows are range-partitioned by group and value and written to the shared
   checkpoint folder with their range number;
3. a small table of (group, range) totals gives each range's first rank, and with it the
   range that holds each wanted rank;
4. only inside such ranges a running count finds the value at the rank.  A range is a
   bounded part of the data whatever the size of its group;
5. the order statistics at floor/ceil of h = (n−1)p are interpolated as R's type 7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def exact_quantiles(df: DataFrame, value, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Long result (by..., prob, quantile, n) of exact type-7 quantiles of ``value``; rows with a null are left out."""
    by = list(by or [])
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(*by, v.cast("double").alias("__v")).dropna().groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (counts.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id())
              .checkpoint(eager=True))
    group = by or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "__part").agg(F.sum("__c").alias("__rows"))   # groups × ranges
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__rows").over(before), F.lit(0)),
                               "n": F.sum("__rows").over(Window.partitionBy(*group))})
    wanted = parts.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    h = (F.col("n") - 1) * F.col("prob")
    wanted = wanted.select("*", h.alias("__h"), F.explode(F.array(
        F.struct(F.lit(0).alias("hi"), (F.floor(h) + 1).alias("rank")),
        F.struct(F.lit(1).alias("hi"), (F.ceil(h) + 1).alias("rank")))).alias("__t"))
    wanted = wanted.filter((F.col("__t.rank") > F.col("__before")) & (F.col("__t.rank") <= F.col("__before") + F.col("__rows")))
    upto = F.sum("__c").over(Window.partitionBy(*by, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    running = ranged.withColumn("__upto", upto)
    local = F.col("__t.rank") - F.col("__before")
    found = running.join(wanted, [*by, "__part"]).filter((local <= F.col("__upto")) & (local > F.col("__upto") - F.col("__c")))
    ends = found.groupBy(*by, "prob").agg(
        F.max("n").alias("n"), F.max("__h").alias("__h"),
        F.max(F.when(F.col("__t.hi") == 0, F.col("__v"))).alias("__lo"), F.max(F.when(F.col("__t.hi") == 1, F.col("__v"))).alias("__hi"))
    q = F.col("__lo") + (F.col("__h") - F.floor("__h")) * (F.col("__hi") - F.col("__lo"))
    return ends.select(*by, "prob", q.alias("quantile"), "n")


def quantile_columns(df: DataFrame, value, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Wide form: one column per named probability, plus n."""
    by = list(by or [])
    long = exact_quantiles(df, value, list(probs.values()), by)
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(name)
            for name, p in probs.items()]
    return long.groupBy(*by).agg(*aggs, F.max("n").alias("n"))
