"""Helpers shared by the operators: materialised tables, row subsets, Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raremetrics.session import ensure_checkpoint_dir, ship_package

#: Text bytes handled by one vectorised step; a longer text is one step of its own.
CHUNK_BYTES = 1 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all machines share (``spark.checkpoint.dir``)."""
    return os.path.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs no recomputation of what lies
    before, and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_tasks(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``run`` over the Arrow batches of each partition, on workers that have this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(taken, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column in ``taken`` has it (case does not count)."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def empty_rows(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def text_chunks(batch: pa.RecordBatch, column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes."""
    if not batch.num_rows:
        return
    buf, off = utf8(batch.column(batch.schema.get_field_index(column)))
    n, lo = batch.num_rows, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi
