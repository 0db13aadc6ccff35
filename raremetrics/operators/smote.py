"""SMOTE over-/under-sampling (Q6) with exact k-nearest minority neighbours.

Semantics (perc.over, perc.under as in the reference's call): each minority case
gets perc.over/100 synthetic cases; a synthetic case lies on the segment from the
case to one of its k nearest minority neighbours (numeric: case + u·(neighbour −
case); nominal: the case's or the neighbour's value with equal chance); the
majority class is sampled with replacement to perc.under/100 × #synthetic rows.
Distances use numeric attributes scaled by their minority range, plus 1 for each
nominal attribute that differs.

Neighbours are exact (:mod:`.neighbours`): a bounded tree over nominal levels and numeric
ranges, in which rows of other levels are read only where a row's own levels hold too few
within distance 1.
Random choices are md5-keyed hashes, reproducible on any layout.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import neighbours, sampling


def _u(id_col: str, seed, tag: str) -> F.Column:
    """Uniform [0, 1) from md5 of (id, seed, tag)."""
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)), F.lit(tag)))
    return sampling.hash_int(h, 13).cast("double") / F.lit(float(16 ** 13))


def knn_minority(m: DataFrame, id_col: str, numeric: list[str], nominal: list[str], k: int = 5) -> DataFrame:
    """Exact k nearest neighbours (other rows) within ``m``; returns (id, nb_id, dist, rank).

    ``numeric`` columns must already be scaled to [0, 1]."""
    return neighbours.nearest(m, id_col, numeric, nominal, k)


def smote(df: DataFrame, label: str, id_col: str, numeric: list[str], nominal: list[str],
          perc_over: int = 100, perc_under: int = 200, k: int = 5, seed=666) -> DataFrame:
    """Q6: balanced frame = sampled majority rows + minority rows + synthetic minority rows.

    Adds ``synthetic`` (bool) and ``draw``, which counts the draws of one majority row. perc_over must be a multiple of 100 here (the call in
    the reference uses 100)."""
    if perc_over % 100 != 0 or perc_over <= 0:
        raise ValueError("perc_over must be a positive multiple of 100")
    n_new = perc_over // 100
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)  # every part of the result reads it
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    minority = min(counts, key=lambda c: (counts[c], str(c)))
    mino = df.filter(F.col(label) == F.lit(minority))
    rng = mino.agg(*[F.min(c).alias(f"__lo_{c}") for c in numeric], *[F.max(c).alias(f"__hi_{c}") for c in numeric])
    scaled = mino.crossJoin(F.broadcast(rng)).select(
        id_col, *nominal,
        *[((F.col(c) - F.col(f"__lo_{c}")) / F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"),
                                                     F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).otherwise(F.lit(1.0)))
          .alias(c) for c in numeric])
    nn = knn_minority(scaled, id_col, numeric, nominal, k)
    held = max(1, min(k, counts[minority] - 1))  # a class of k rows or fewer has no k others
    # synthetic rows: replicate r = 1..n_new, pick neighbour rank by hash, interpolate
    base = mino.withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(n_new))))
    base = base.withColumn("__key", F.concat_ws("#", F.col(id_col).cast("string"), F.col("__r").cast("string")))
    base = base.withColumn("__pick", (F.lit(1) + F.floor(_u("__key", seed, "nb") * F.lit(float(held)))).cast("int"))
    nb = mino.select(F.col(id_col).alias("nb_id"), *[F.col(c).alias(f"__nb_{c}") for c in numeric + nominal])
    j = (base.join(nn.select(id_col, "nb_id", F.col("rank").alias("__pick")), on=[id_col, "__pick"], how="inner")
         .join(nb, on="nb_id", how="inner"))
    gap = _u("__key", seed, "gap")
    syn_cols = {c: F.col(c) + gap * (F.col(f"__nb_{c}") - F.col(c)) for c in numeric}
    syn_cols.update({c: F.when(_u("__key", seed, f"nom_{c}") < 0.5, F.col(c)).otherwise(F.col(f"__nb_{c}"))
                     for c in nominal})
    synthetic = (j.withColumns(syn_cols)
                 .withColumn(id_col, -F.abs(F.xxhash64(F.col("__key"), F.lit(str(seed)))))
                 .select(*df.columns).withColumn("synthetic", F.lit(True)))
    n_syn = counts[minority] * n_new
    n_maj = int(math.floor(perc_under / 100.0 * n_syn))
    maj = df.filter(F.col(label) != F.lit(minority))
    # majority drawn with replacement: draw j → row of rank 1 + hash(seed, j) mod n_majority
    ranked = sampling.stratified_rank(maj.withColumn("__s", F.lit(1)), ["__s"], id_col, seed)
    n_major = sum(v for c, v in counts.items() if c != minority)
    draws = (ranked.select("rank", F.col(id_col).alias("__src"))
             .filter(F.col("rank") <= F.lit(n_maj))
             .select(F.col("rank").alias("__j"))
             .withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("maj"), F.col("__j").cast("string")))))
    if n_maj > n_major:
        # more draws than majority rows: add the extra draw slots from repeated passes over the ranks
        reps = math.ceil(n_maj / n_major)
        draws = (ranked.select(F.col("rank").alias("__r0"))
                 .withColumn("__pass", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
                 .select((F.col("__pass") * F.lit(n_major) + F.col("__r0")).alias("__j"))
                 .filter(F.col("__j") <= F.lit(n_maj))
                 .withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("maj"), F.col("__j").cast("string")))))
    target = draws.select((F.lit(1) + F.pmod(sampling.hash_int(F.col("__h")), F.lit(n_major))).alias("rank"))
    sampled = (target.groupBy("rank").agg(F.count(F.lit(1)).alias("__times"))
               .join(ranked, on="rank", how="inner")
               .withColumn("__t", F.explode(F.sequence(F.lit(1), F.col("__times"))))
               .select(*df.columns, F.lit(False).alias("synthetic"), F.col("__t").alias("draw")))
    once = mino.withColumn("synthetic", F.lit(False)).unionByName(synthetic).withColumn("draw", F.lit(1))
    return sampled.unionByName(once)
