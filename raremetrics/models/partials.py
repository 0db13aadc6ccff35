"""Sums of numeric arrays over a table, by key, without a row per number.

Tasks emit (key, values) rows whose values are one flat array of doubles, for instance a
block of a Gram matrix or a histogram.  A first shuffle by (key, part) adds the arrays of
each key's share of the tasks, a second one by key adds those sums: no task holds more
than one sum at a time or reads more than about the root of a key's rows, and the number
of shuffled rows does not depend on the arrays' length.  The driver gets one array a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key int, part int, values binary"
#: First-level sums of each key.
PARTS = 16
#: Tasks whose sums are added at one level.
DIRECT = 64


def rows(sums: dict[int, np.ndarray], part: int) -> pd.DataFrame:
    """One task's rows; ``part`` says in which first-level sum they go."""
    return pd.DataFrame({"key": np.fromiter(sums, np.int32, len(sums)), "part": np.full(len(sums), part % PARTS, np.int32),
                         "values": [np.ascontiguousarray(v, np.float64).tobytes() for v in sums.values()]})


def task() -> int:
    """This task's number."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _added(batches):
    last, total, out = None, None, []

    def frame():
        return pd.DataFrame({"key": [o[0][0] for o in out], "part": [o[0][1] for o in out], "values": [o[1].tobytes() for o in out]})

    for pdf in batches:
        for key, part, raw in zip(pdf["key"], pdf["part"], pdf["values"], strict=True):
            if (key, part) != last:
                if last is not None:
                    out.append((last, total))
                last, total = (key, part), np.zeros(len(raw) // 8)
            total = total + np.frombuffer(raw)
        if out:
            yield frame()
            out = []
    if last is not None:
        out = [(last, total)]
        yield frame()


def summed(parts: DataFrame, tasks: int | None = None) -> dict[int, np.ndarray]:
    """Sum of the arrays of each key of a table with the columns of ``SCHEMA``.

    ``tasks`` is the number of tasks that emit, where it is known: up to ``DIRECT`` of them need no first level."""
    if tasks is None or tasks > DIRECT:
        parts = parts.repartition("key", "part").sortWithinPartitions("key", "part").mapInPandas(_added, SCHEMA)
    whole = parts.withColumn("part", F.lit(0)).repartition("key").sortWithinPartitions("key").mapInPandas(_added, SCHEMA)
    return {r["key"]: np.frombuffer(r["values"]) for r in whole.collect()}
