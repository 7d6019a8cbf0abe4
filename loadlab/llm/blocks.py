"""Vectors as whole numbers, held in blocks that stay where they are over many rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlab.session import new_folder, stage

#: Vectors of a block, and blocks of a file: a reader holds no more than a file's blocks at once.
BLOCK = 4096
BLOCKS_A_FILE = 32


def largest(dimension: int) -> int:
    """Components up to this size have squared distances that doubles hold exactly."""
    return int((2**51 / max(dimension, 1)) ** 0.5)


def floored(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of every component; NULL if the vector is, or holds NULL, NaN or infinity."""
    x = vector.cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(x, lambda c: F.floor(c * float(factor)).cast("bigint")))


def within(x: Column, dimension: int) -> Column:
    """Whether vectors have this dimension and no component too large for exact distances."""
    bound = largest(dimension)
    return F.coalesce((F.size(x) == dimension) & F.forall(x, lambda c: c.between(-bound, bound)), F.lit(False))


def smallest(rows: DataFrame, n: int) -> np.ndarray:
    """The vectors ``x`` of the ``n`` rows that come first by ``rank`` (NULL last), then ``x``.

    Each task keeps its own ``n``, so that what meets in one place is a bounded share of the rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema = None
        for batch in batches:
            schema = batch.schema
            ranks = batch.column("rank")
            if len(held) == n and held[-1][1] is not None:
                batch = batch.filter(pc.less_equal(ranks, pa.scalar(held[-1][1], ranks.type)).fill_null(False))
            pairs = zip(batch.column("rank").to_pylist(), batch.column("x").to_pylist())
            held = sorted(held + [(r is None, r, x) for r, x in pairs], key=lambda h: (h[0], "" if h[0] else h[1], h[2]))[:n]
            # NULL ranks compare by x alone, and never with others: the flag before them differs.
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], schema.field(i - 1).type) for i in (1, 2)], names=["rank", "x"])

    rows = rows.select("rank", "x")
    per_task = stage(rows.mapInArrow(first, rows.schema), "smallest")
    found = per_task.orderBy(F.col("rank").asc_nulls_last(), "x").limit(n).collect()
    return np.array([r.x for r in found], dtype=np.int64)


def in_blocks(rows: DataFrame, work: Callable[[pa.Table], dict], schema: str, name: str) -> tuple[DataFrame, str]:
    """``work`` applied to blocks of up to ``BLOCK`` rows of each task, one staged row for each; with its folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == BLOCK:
                    yield one_row(work(pa.Table.from_batches(held)))
                    held, count = [], 0
        if count:
            yield one_row(work(pa.Table.from_batches(held)))

    return staged_blocks(rows.mapInArrow(run, schema), name)


def staged_blocks(blocks: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Written to the shared folder and read again; with the folder."""
    spark: SparkSession = blocks.sparkSession
    path = new_folder(spark, name)
    blocks.write.option("maxRecordsPerFile", BLOCKS_A_FILE).parquet(path)
    return spark.read.schema(blocks.schema).parquet(path), path


def one_row(columns: dict) -> pa.RecordBatch:
    """A block's row: Arrow arrays become lists, numpy arrays their bytes, other values stay."""
    arrays = []
    for value in columns.values():
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        if isinstance(value, pa.Array):
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value))
        else:
            arrays.append(pa.array([value.tobytes() if isinstance(value, np.ndarray) else value]))
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def matrix(vectors: pa.ChunkedArray, dimension: int) -> np.ndarray:
    return np.asarray(vectors.combine_chunks().flatten()).reshape(-1, dimension).astype(np.int32)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, exact for whole numbers within ``largest``."""
    p, e = points.astype(float), entries.astype(float)
    return (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)


def label_texts(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if df.schema[c].dataType.simpleString() == "string"]
