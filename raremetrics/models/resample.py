"""Stratified resampling with replacement as row weights, drawn inside the tasks.

A bootstrap replicate draws as many rows of each stratum as it has, with replacement:
each row's number of draws is one count of a multinomial.  The draws of a stratum are
split over the partitions by conditional binomials down a binary tree of partitions, then over blocks
of rows inside a partition, then over the rows of a block.  Every generator is seeded by
replicate set, stratum and place, so a task finds its share alone, a repeated task draws the
same, and the sizes are exact.  No row is copied and no draw is shuffled.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import partials

#: Rows whose draws are made at once.
BLOCK = 4096


@dataclass
class Draws:
    """Replicates of a frame whose partitions hold ``upto`` rows of each key (cumulated over the partitions)."""

    columns: list[str]
    replicates: int
    seed: int
    upto: dict[tuple, np.ndarray]

    def _random(self, key: tuple, *place: int) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64([self.seed, zlib.crc32(repr(key).encode()), *place]))

    def share(self, key: tuple, part: int) -> np.ndarray:
        """Draws of each replicate that fall in the partition."""
        upto = self.upto[key]
        lo, hi = 0, len(upto) - 1
        draws = np.full(self.replicates, upto[-1], np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left, both = upto[mid] - upto[lo], upto[hi] - upto[lo]
            first = self._random(key, 1, lo, hi).binomial(draws, left / both if both else 0.0)
            draws, lo, hi = (first, lo, mid) if part < mid else (draws - first, mid, hi)
        return draws

    def task(self) -> "TaskDraws":
        return TaskDraws(self, partials.task())


@dataclass
class WeightColumns:
    """Replicates whose draws of each row stand in its own columns."""

    columns: list[str]

    @property
    def replicates(self) -> int:
        return len(self.columns)

    def weights(self, frame) -> np.ndarray:
        return frame[self.columns].to_numpy(dtype=float)


class TaskDraws:
    """The counts of one partition's rows, in the order in which they are read."""

    def __init__(self, draws: Draws, part: int):
        self.draws, self.part = draws, part
        self.state: dict[tuple, list] = {}

    def _block(self, key: tuple) -> np.ndarray:
        """Counts of the next block of the key's rows (rows by replicates)."""
        state = self.state.get(key)
        if state is None:
            upto = self.draws.upto[key]
            state = self.state[key] = [int(upto[self.part + 1] - upto[self.part]), self.draws.share(key, self.part), self.draws._random(key, 2, self.part), None]
        rows, left, random, _ = state
        m = min(BLOCK, rows)
        mine = left if m == rows else random.binomial(left, m / rows)
        state[0], state[1] = rows - m, left - mine
        at = random.integers(0, m, int(mine.sum())) * len(mine) + np.repeat(np.arange(len(mine)), mine)
        return np.bincount(at, minlength=m * len(mine)).reshape(m, len(mine))

    def weights(self, frame) -> np.ndarray:
        """Counts of a batch's rows (rows by replicates)."""
        out = np.zeros((len(frame), self.draws.replicates))
        for key, rows in frame.groupby(self.draws.columns, sort=False).indices.items():
            key = key if isinstance(key, tuple) else (key,)
            held = self.state[key][3] if key in self.state and self.state[key][3] is not None else np.zeros((0, self.draws.replicates))
            while len(held) < len(rows):
                held = np.concatenate([held, self._block(key)])
            out[rows], self.state[key][3] = held[:len(rows)], held[len(rows):]
        return out


def draws(frame: DataFrame, columns: list[str], replicates: int, seed: int = 666) -> Draws:
    """Replicates of a checkpointed frame, stratified by ``columns`` (text or whole numbers, without nulls)."""
    parts = frame.rdd.getNumPartitions()
    # a row for each partition and stratum
    rows = frame.groupBy(*columns, F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    count: dict[tuple, np.ndarray] = {}
    for r in rows:
        count.setdefault(tuple(r[c] for c in columns), np.zeros(parts + 1, np.int64))[r["part"] + 1] = r["n"]
    return Draws(list(columns), replicates, seed, {k: np.cumsum(v) for k, v in count.items()})
