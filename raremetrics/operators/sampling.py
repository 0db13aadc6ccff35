"""Deterministic, exact-size sampling: stratified split, CV folds, stratified bootstrap (Q5, Q7, Q8).

Randomness is a keyed hash: md5 of "<id>:<seed>[:<repeat>]" orders rows inside a
stratum, so results are reproducible on any cluster layout (and in SQL).

Exact ranks within a stratum never put a whole stratum in one task: rows are
bucketed by the first 3 hex digits of their hash (4,096 buckets); per-bucket
counts (a small table) give each bucket's offset, and only rows of the same
(stratum, bucket) are ranked together by a window — about n/4,096 rows each even
when one stratum holds a third of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N_BUCKET_HEX = 3


def hash_key(id_col: str, seed, extra=None) -> F.Column:
    parts = [F.col(id_col).cast("string"), F.lit(str(seed))]
    if extra is not None:
        parts.append(extra.cast("string") if isinstance(extra, F.Column) else F.lit(str(extra)))
    return F.md5(F.concat_ws(":", *parts))


def hash_int(h: F.Column, digits: int = 15) -> F.Column:
    """First ``digits`` hex digits of an md5 string as a non-negative bigint."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def stratified_rank(df: DataFrame, strata: list[str], id_col: str, seed, extra=None,
                    rank_col: str = "rank", n_col: str = "n_stratum") -> DataFrame:
    """Exact 1-based rank of each row inside its stratum by (hash, id), plus stratum size."""
    h = hash_key(id_col, seed, extra)
    d = df.withColumns({"__h": h, "__b": F.conv(F.substring(h, 1, N_BUCKET_HEX), 16, 10).cast("int")})
    counts = d.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select(*strata, "__b",
                            (F.sum("__cnt").over(w) - F.col("__cnt")).alias("__before"),
                            F.sum("__cnt").over(Window.partitionBy(*strata)).alias(n_col))
    wr = Window.partitionBy(*strata, "__b").orderBy("__h", id_col)
    j = d.join(offsets, on=[*strata, "__b"], how="inner")
    return (j.withColumn(rank_col, F.col("__before") + F.row_number().over(wr))
            .drop("__h", "__b", "__before"))


def stratified_split(df: DataFrame, strata: list[str], id_col: str, frac: float = 0.7, seed=666,
                     out: str = "split") -> DataFrame:
    """Q5: per stratum, the first ceil(frac·n) rows by hash are 'train', the rest 'test'."""
    r = stratified_rank(df, strata, id_col, seed)
    k = F.ceil(F.lit(float(frac)) * F.col("n_stratum"))
    return r.withColumn(out, F.when(F.col("rank") <= k, F.lit("train")).otherwise(F.lit("test"))) \
            .drop("rank", "n_stratum")


def cv_folds(df: DataFrame, strata: list[str], id_col: str, k: int = 10, repeats: int = 3, seed=666) -> DataFrame:
    """Q8: repeated stratified K-fold labels: one row per (row, repeat) with ``fold`` 1..k
    equal to ntile(k) over the stratum ordered by hash(id, seed, repeat)."""
    rep = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    r = stratified_rank(rep, strata + ["repeat"], id_col, seed, F.col("repeat"))
    n, rk = F.col("n_stratum"), F.col("rank")
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    fold = F.when(rk <= big, F.ceil(rk / (q + 1))).otherwise(rem + F.ceil((rk - big) / q))
    return r.withColumn("fold", fold.cast("int")).drop("rank", "n_stratum")


def bootstrap_counts(df: DataFrame, strata: list[str], id_col: str, replicates: int, seed=666) -> DataFrame:
    """Q7: stratified bootstrap with replacement, same size per stratum, as draw counts.

    Row with rank j is the j-th draw slot of its stratum in every replicate b; the slot
    draws the row of rank 1 + (md5(seed:b:stratum:j) mod n). Slots are spread over the
    data's own partitions, counts are aggregated per (replicate, drawn row) and joined
    back, so no stratum is expanded inside one task. Output: (replicate, <id>, count)
    for rows drawn at least once.
    """
    r = stratified_rank(df, strata, id_col, seed)
    skey = F.concat_ws("|", *[F.col(s).cast("string") for s in strata]) if strata else F.lit("")
    slots = r.select(*strata, skey.alias("__s"), "rank", "n_stratum",
                     F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("__s"),
                          F.col("rank").cast("string")))
    draws = slots.select(*strata, "replicate",
                         (F.lit(1) + F.pmod(hash_int(h), F.col("n_stratum"))).alias("rank"))
    cnt = draws.groupBy(*strata, "replicate", "rank").agg(F.count(F.lit(1)).alias("count"))
    return (cnt.join(r.select(*strata, "rank", id_col), on=[*strata, "rank"], how="inner")
            .select("replicate", *strata, id_col, "count"))
