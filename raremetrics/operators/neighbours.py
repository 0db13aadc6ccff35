"""Exact k nearest neighbours over numeric and nominal columns, by a bounded search tree.

The squared distance of two rows is the sum of squared differences of the numeric columns
plus one for every nominal column that differs.  Rows at one place (equal in all columns)
are one location with its smallest ids, so copies cost nothing.  A tree over the locations,
built on a hash sample and at most ``LEAVES`` leaves wide, first parts nominal levels (they
lie 1 apart) and then numeric ranges.  Every location searches its own leaf; the distance
it finds there tells which other leaves can hold something nearer, by their boxes and levels.
Rows of other nominal levels are at least 1 away, so leaves of other levels are read only
by those whose own have nothing within 1.  The nearest such leaves come first and shrink
the distance again; the remaining ones follow.  Every leaf that could matter is read, so
the result is exact, and no round compares all pairs.

A task holds one leaf's locations and reads its queries in a stream, at most ``QUERIES`` of
one leaf; a leaf with more is read by several tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Locations of a leaf, about, where the bound on the leaves allows it.
LEAF = 256
LEAVES = 4096
#: Locations that the tree is built on: balance depends on them, results do not.
SAMPLE = 65_536
QUERIES = 8192
#: Queries compared with all boxes at a time.
STEP = 512
#: Leaves read in the second round; the third reads all that are left.
NEAREST = 4
#: Levels of a nominal column that a leaf's description lists; with more, it counts as holding all.
LEVELS = 64


class Tree:
    """Splits of the sample, halving the dimension that spreads most."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, size: float):
        self.nodes: list[tuple] = []  # (dimension, cut or levels of the left, left node, right node), or the leaf's number
        self.leaves = 0
        self._grow(x, levels, size)

    def _grow(self, x: np.ndarray, levels: np.ndarray, size: float) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        split = self._split(x, levels) if len(x) > size else None
        if split is None:
            self.nodes[at] = (-1, self.leaves, 0, 0)
            self.leaves += 1
        else:
            dim, cut, left = split
            self.nodes[at] = (dim, cut, self._grow(x[left], levels[left], size), self._grow(x[~left], levels[~left], size))
        return at

    @staticmethod
    def _split(x: np.ndarray, levels: np.ndarray):
        d = x.shape[1]
        for j in range(levels.shape[1]):
            found, count = np.unique(levels[:, j], return_counts=True)
            if len(found) > 1:
                half = found[:max(1, int(np.searchsorted(np.cumsum(count), len(levels) / 2, "right")))]
                return d + j, half, np.isin(levels[:, j], half)
        if d:
            for j in np.argsort(-(x.max(axis=0) - x.min(axis=0)), kind="stable").tolist():
                cut = np.median(x[:, j])
                left = x[:, j] <= cut
                if left.all():
                    left = x[:, j] < cut
                    cut = x[left, j].max() if left.any() else cut
                if left.any():
                    return j, cut, left
        return None

    def leaf(self, x: np.ndarray, levels: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            dim, cut, left, right = self.nodes[node]
            if dim < 0:
                out[rows] = cut
                continue
            goes = x[rows, dim] <= cut if dim < x.shape[1] else np.isin(levels[rows, dim - x.shape[1]], cut)
            todo += [(left, rows[goes]), (right, rows[~goes])]
        return out


class Boxes:
    """What each leaf holds: ranges of the numeric columns and levels of the nominal ones."""

    def __init__(self, rows: list, d: int, m: int):
        self.leaf = np.array([r["leaf"] for r in rows], np.int32)
        self.low = np.array([list(r["low"]) for r in rows], float).reshape(len(rows), d)
        self.high = np.array([list(r["high"]) for r in rows], float).reshape(len(rows), d)
        self.levels = [[None if len(r[f"s{j}"]) > LEVELS else np.array(r[f"s{j}"], np.int64) for j in range(m)] for r in rows]

    def bounds(self, x: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Squared distances from rows to leaves that nothing in the leaf can be nearer than."""
        out = np.zeros((len(x), len(self.leaf)))
        for j in range(x.shape[1]):
            out += np.maximum(np.maximum(self.low[:, j] - x[:, j, None], x[:, j, None] - self.high[:, j]), 0) ** 2
        for i, of in enumerate(self.levels):
            for j, held in enumerate(of):
                if held is not None:
                    out[:, i] += ~np.isin(levels[:, j], held)
        return out


def locations(points: DataFrame, id_col: str, numeric: list[str], nominal: list[str], k: int) -> DataFrame:
    """(loc, ids, x, levels): the places of the points, each with its k + 1 smallest ids; ``loc`` is the smallest."""
    place = points.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in numeric]).cast("array<double>").alias("x"),
                          F.array(*[F.coalesce(F.xxhash64(F.when(F.col(c).isNotNull(), F.col(c).cast("string"))), F.lit(0)) for c in nominal]).cast("array<bigint>").alias("levels"))
    # of a place that very many rows share, parts are cut to the smallest ids before they meet
    parts = place.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1024)))
    few = parts.withColumn("r", F.row_number().over(Window.partitionBy("x", "levels", "salt").orderBy("id"))).filter(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("x", "levels").orderBy("id"))).filter(F.col("r") <= k + 1)
    return few.groupBy("x", "levels").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("loc"), "ids", "x", "levels")


def _arrays(pdf: pd.DataFrame, d: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.array(pdf["x"].tolist(), float).reshape(len(pdf), d), np.array(pdf["levels"].tolist(), np.int64).reshape(len(pdf), m))


def _nearest_places(x, levels, q, q_levels, loc, k):
    """For each query the k + 1 nearest rows by (distance, loc): indexes and squared distances."""
    step = max(1, 2_000_000 // max(len(x), 1))
    for lo in range(0, len(q), step):
        d2 = np.zeros((min(step, len(q) - lo), len(x)))
        for j in range(x.shape[1]):
            d2 += (q[lo:lo + step, j, None] - x[None, :, j]) ** 2
        for j in range(levels.shape[1]):
            d2 += q_levels[lo:lo + step, j, None] != levels[None, :, j]
        for i, row in enumerate(d2):
            near = np.arange(len(row)) if len(row) <= k + 1 else np.flatnonzero(row <= np.partition(row, k)[k])
            near = near[np.lexsort((loc[near], row[near]))][:k + 1]
            yield lo + i, near, row[near]


def _search(places: DataFrame, queries: DataFrame, k: int, d: int, m: int) -> DataFrame:
    """(loc, nb, d2) of the k + 1 nearest ids in each leaf that a query (leaf, loc, x, levels) is sent to."""
    load = queries.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))  # one row a leaf
    held = places.join(load, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), "loc", "ids", "x", "levels")
    asked = queries.join(load, "leaf").select("leaf", F.pmod(F.xxhash64("loc"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("kind"), "loc",
                                              F.array().cast("array<bigint>").alias("ids"), "x", "levels")
    rows = held.unionByName(asked).repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "kind", "loc")

    def run(batches):
        last, parts, leaf = None, [], None
        for pdf in batches:
            for key, own in pdf.groupby(["leaf", "chunk"], sort=False):
                if key != last:
                    last, parts, leaf = key, [], None
                parts.append(own[own["kind"] == 0])
                ask = own[own["kind"] == 1]
                if not len(ask):
                    continue
                if leaf is None:
                    all_ = pd.concat(parts)
                    leaf = (*_arrays(all_, d, m), all_["loc"].to_numpy(), all_["ids"].tolist())
                x, levels, loc, ids = leaf
                out: list[list] = [[], [], []]
                names = ask["loc"].to_numpy()
                for i, near, d2 in _nearest_places(x, levels, *_arrays(ask, d, m), loc, k):
                    found = sorted((float(v), int(one)) for v, at in zip(d2, near, strict=True) for one in ids[at])[:k + 1]
                    out[0] += [names[i]] * len(found)
                    out[1] += [f[1] for f in found]
                    out[2] += [f[0] for f in found]
                yield pd.DataFrame({"loc": out[0], "nb": out[1], "d2": out[2]})

    return rows.mapInPandas(run, "loc long, nb long, d2 double")


def nearest(points: DataFrame, id_col: str, numeric: list[str], nominal: list[str], k: int = 5) -> DataFrame:
    """Exact k nearest other rows of each row: (id, nb_id, dist, rank), ordered by distance and id.

    Ids are whole numbers, unique; null levels equal each other.  With fewer than k other rows all are returned."""
    ensure_checkpoint_dir(points.sparkSession)
    d, m = len(numeric), len(nominal)
    points = points.select(id_col, *numeric, *nominal).checkpoint(eager=True)
    places = locations(points, id_col, numeric, nominal, k).checkpoint(eager=True)
    n = places.count()
    if n == 0:
        return points.sparkSession.createDataFrame([], "id long, nb_id long, dist double, rank int").withColumnRenamed("id", id_col)
    rate = min(1.0, SAMPLE / max(n, 1))
    unit = F.pmod(F.xxhash64("loc", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    x, levels = _arrays(places.filter(unit < rate).select("x", "levels").toPandas(), d, m)
    tree = Tree(x, levels, max(LEAF, n / LEAVES) * rate)

    def place(batches):
        for pdf in batches:
            yield pdf.assign(leaf=tree.leaf(*_arrays(pdf, d, m)))

    places = places.mapInPandas(place, "loc long, ids array<long>, x array<double>, levels array<long>, leaf int").checkpoint(eager=True)
    held = places.groupBy("leaf").agg(
        F.array(*[F.min(F.col("x")[j]) for j in range(d)]).cast("array<double>").alias("low"), F.array(*[F.max(F.col("x")[j]) for j in range(d)]).cast("array<double>").alias("high"),
        *[F.slice(F.collect_set(F.col("levels")[j]), 1, LEVELS + 1).alias(f"s{j}") for j in range(m)])
    boxes = Boxes(held.collect(), d, m)  # at most ``LEAVES`` rows, about

    best = None
    order = Window.partitionBy("loc").orderBy("d2", "nb")
    queries = places.select("leaf", "loc", "x", "levels")
    for last in (0, NEAREST, None):
        if last != 0:
            far = best.groupBy("loc").agg(F.when(F.count("*") == k + 1, F.max("d2")).alias("far"))

            def reach(batches, last=last):
                """Leaves that can hold something nearer: the nearest ones, then all others."""
                steps = (pdf.iloc[lo:lo + STEP] for pdf in batches for lo in range(0, len(pdf), STEP))
                for pdf in steps:
                    low = boxes.bounds(*_arrays(pdf, d, m))
                    low[pdf["leaf"].to_numpy()[:, None] == boxes.leaf[None, :]] = np.inf  # its own has been read
                    rank = np.argsort(np.argsort(low, axis=1, kind="stable"), axis=1)
                    far = pdf["far"].fillna(np.inf).to_numpy()
                    use = np.isfinite(low) & (low <= far[:, None] * (1 + 1e-12)) & ((rank < NEAREST) if last else (rank >= NEAREST))
                    i, j = np.nonzero(use)
                    yield pd.DataFrame({"leaf": boxes.leaf[j], "loc": pdf["loc"].to_numpy()[i], "x": pdf["x"].to_numpy()[i], "levels": pdf["levels"].to_numpy()[i]})

            queries = (places.join(far, "loc").select("leaf", "loc", "x", "levels", "far")
                       .mapInPandas(reach, "leaf int, loc long, x array<double>, levels array<long>"))
        queries = queries.checkpoint(eager=True)
        if queries.isEmpty():
            continue  # nothing nearer can lie in the other leaves
        found = _search(places.select("leaf", "loc", "ids", "x", "levels"), queries, k, d, m)
        found = found if best is None else best.unionByName(found)
        best = (found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).select("loc", "nb", "d2").checkpoint(eager=True))
    lists = best.groupBy("loc").agg(F.sort_array(F.collect_list(F.struct("d2", "nb"))).alias("near"))
    lists = lists.join(places.select("loc", F.col("x").alias("at_x"), F.col("levels").alias("at_levels")), "loc")
    own = points.select(F.col(id_col).alias("own_id"), F.array(*[F.col(c).cast("double") for c in numeric]).cast("array<double>").alias("own_x"),
                        F.array(*[F.coalesce(F.xxhash64(F.when(F.col(c).isNotNull(), F.col(c).cast("string"))), F.lit(0)) for c in nominal]).cast("array<bigint>").alias("own_levels"))
    each = own.join(lists, (F.col("own_x") == F.col("at_x")) & (F.col("own_levels") == F.col("at_levels")))
    others = F.slice(F.filter("near", lambda c: c["nb"] != F.col("own_id")), 1, k)
    return each.select("own_id", F.posexplode(others).alias("pos", "c")).select(
        F.col("own_id").alias(id_col), F.col("c.nb").alias("nb_id"), F.sqrt("c.d2").alias("dist"), (F.col("pos") + 1).alias("rank"))
