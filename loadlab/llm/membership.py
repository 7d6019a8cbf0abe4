"""A table of bits that tells which keys are surely not wanted.

It is of a fixed size and only saves work: rows that pass it still have to be joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 25


def place_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def filter_bits(keys: DataFrame, place: Column) -> Broadcast:
    """A bit per place below ``BITS``: at most ``BITS / 64`` numbers reach the driver, whatever the number of keys."""
    words = keys.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")
    )
    table = words.toArrow()
    bits = np.zeros(BITS // 64, dtype=np.int64)
    bits[table["w"].to_numpy()] = table["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits)


def passing(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def in_filter(bits: Broadcast, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows with a column ``place``: those that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array(passing(bits.value, batch.column("place").to_numpy()))
            yield batch.select(keep).filter(near)

    return run
