"""Connected components of an edge table, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raremetrics.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of an edge table (u, v): the smallest node of its component.

    Every round replaces edges by edges to the smallest neighbour; minima are aggregated
    before they are shuffled, written, and joined back, so that the adaptive join can split
    the edges of a node that has very many.  Rounds are written to the shared folder and end when nothing changes.
    """
    edges = common.materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = common.materialise(large, "edges")
        least = common.materialise(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = (large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter("u <> v").distinct())
        edges = common.materialise(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # every edge now leads to its component's smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
