"""Feature preparation (Q2-Q4): centring/scaling, factor encoding, assembling."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centre_scale(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Q2: (x − mean)/sd with sample sd; statistics from one global aggregate (one row, broadcast)."""
    st = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(st))
    out = out.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}") for c in cols})
    return out.drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])


def encode_factors(df: DataFrame, factors: list[str], drop_first: bool = True):
    """Q3: index each factor with levels in alphabetical order and one-hot encode it
    (first level as the reference when ``drop_first``). Returns (frame, fitted models)."""
    idx = StringIndexer(inputCols=factors, outputCols=[f"{f}_idx" for f in factors],
                        stringOrderType="alphabetAsc", handleInvalid="skip")
    im = idx.fit(df)
    d = im.transform(df)
    enc = OneHotEncoder(inputCols=[f"{f}_idx" for f in factors], outputCols=[f"{f}_vec" for f in factors],
                        dropLast=False, handleInvalid="error")
    em = enc.fit(d)
    d = em.transform(d)
    if drop_first:
        # reference level = first alphabetical level: remove its slot
        from pyspark.ml.functions import array_to_vector, vector_to_array
        d = d.withColumns({f"{f}_vec": array_to_vector(F.slice(vector_to_array(f"{f}_vec"), 2, 1 << 20))
                           for f in factors})
    return d, (im, em)


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Q4: assemble numeric / encoded columns into one feature vector."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip").transform(df)
