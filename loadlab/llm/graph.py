"""Connected components of a table of links, on Spark alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadlab.session import stage

#: Links a task gathers before it contracts them.
_AT_ONCE = 1 << 20


def lowest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest node each of ``0 .. nodes - 1`` is connected with by the links ``a[i] - b[i]``."""
    low = np.arange(nodes)
    while True:
        least = low.copy()
        np.minimum.at(least, low[a], low[b])
        np.minimum.at(least, low[b], low[a])
        least = np.minimum(least, least[low])
        while not np.array_equal(least, least[least]):
            least = least[least]
        if np.array_equal(least, low):
            return low
        low = least


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars: each end with the smallest one it is connected with here."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([b.column(c).to_numpy() for c in ("u", "v") for b in held])
        ids, at = np.unique(ends, return_inverse=True)
        low = lowest(at[: len(at) // 2], at[len(at) // 2 :], len(ids))
        moved = np.flatnonzero(low != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[low[moved]])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _AT_ONCE:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component_id`` of every end of a link: the smallest id it reaches.

    Links are contracted to stars where they lie, so a node has at most one link a task.  These meet once by node: it keeps the one with its
    smallest neighbour, and its other neighbours are linked to that one, so that what is shuffled from then on is little more than a
    forest.  Then large and small stars alternate: every node links its larger
    neighbours, then its smaller ones, to the smallest it sees, until nobody
    is both a centre and a ray.  The number of rounds grows with the logarithm of the
    longest path.  Minima are combined before they are shuffled, so a node with very many
    neighbours is no hot spot there, and the joins are plain inner joins which adaptive
    execution splits.  Every round is a table in the shared folder.
    """
    ends = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    neighbours = ends.mapInArrow(_contract, "u bigint, v bigint").groupBy("u").agg(F.collect_set("v").alias("all"))
    least = neighbours.select("u", "all", F.array_min("all").alias("v"))
    others = least.select(F.explode(F.array_remove("all", F.col("v"))).alias("u"), "v")
    forest = least.select("u", "v").unionByName(others.distinct())
    stars = stage(forest.mapInArrow(_contract, "u bigint, v bigint"), "links")
    # As many tasks as there are pieces of links, not more.
    tasks = max(1, stars.rdd.getNumPartitions())
    while not stars.join(stars.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() or _shared(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m"))
        # A table of its own: adaptive execution splits a centre with very many rays only next to a plain shuffle.
        least = stage(least, "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).coalesce(tasks).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("_m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("_m").alias("v")
        )
        stars = stage(small.coalesce(tasks).mapInArrow(_contract, "u bigint, v bigint"), "stars")
    rays = stars.distinct()
    centres = stars.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    return rays.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(centres)


def _shared(stars: DataFrame) -> bool:
    """Whether a ray belongs to two stars."""
    return not stars.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").isEmpty()
