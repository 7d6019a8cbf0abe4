"""Python work on many groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def per_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """``work`` applied to the rows of each combination of the integer ``keys``, which are never NULL.

    Rows are dealt by ``keys`` and sorted, and groups are cut out of the Arrow
    batches of a partition, which costs little for groups of a few rows.  A
    group is held in memory: keys must be such that groups are bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(table: pa.Table, last: bool):
            marks = np.stack([table[k].to_numpy() for k in keys])
            cut = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cut.tolist(), *([table.num_rows] if last else [])]
            for a, b in zip(bounds, bounds[1:]):
                out = work(table.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield from out.to_batches()
            held[:] = [] if last else table.slice(bounds[-1]).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 4096:
                    yield from ready(pa.Table.from_batches(held), False)
        if held:
            yield from ready(pa.Table.from_batches(held), True)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
