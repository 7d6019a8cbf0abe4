"""Centroid clustering with heap-ordered bounds.

Vectors are whole numbers, in blocks that stay in their task from round to round.
In a block each cluster keeps a heap of its vectors by gap: how much farther the second nearest centroid was than the
nearest one when the vector was last compared.  When centroids move, a vector's gap shrinks by at most the way of its
own centroid and the longest way of any other; these add up per cluster, and a gap is stored with
what had added up before, so that nothing in a heap is touched when centroids move.  Vectors whose gap is used
up lie on top of the heap; only they are popped, compared with all centroids and pushed again.

A round reads the blocks of the round before and writes them anew with the sums
of each cluster; of these a row per centroid and component goes to the driver.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadlab.llm import blocks
from loadlab.session import drop_folder, stage

FACTOR = 64
SEED = 1

_BLOCK = "points binary, cluster binary, heap_sizes binary, gaps binary, members binary, counts array<bigint>, sums array<bigint>, scanned bigint"


class Block:
    """Vectors of a block, the cluster of each, and a heap ``(gap, vector)`` per cluster."""

    def __init__(self, points: np.ndarray, size: int):
        self.points = points
        self.cluster = np.full(len(points), -1, dtype=np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(size)]
        self.scanned = 0

    @classmethod
    def read(cls, row: dict, dimension: int) -> Block:
        of = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        sizes = of("heap_sizes", np.int32)
        block = cls(of("points", np.int32).reshape(-1, dimension), len(sizes))
        block.cluster = of("cluster", np.int32).copy()
        entries = list(zip(of("gaps", float).tolist(), of("members", np.int32).tolist()))
        ends = np.cumsum(sizes).tolist()
        # A heap was written as it lay, so it is one again.
        block.heaps = [entries[b - n : b] for b, n in zip(ends, sizes.tolist())]
        return block

    def update(self, centroids: np.ndarray, used: np.ndarray) -> None:
        """Assign every vector to its nearest centroid; ``used`` is what has added up per cluster."""
        # Doubles round: a gap this small counts as none, which costs a look and changes nothing.
        slack = 1e-6 + 1e-12 * (float(np.abs(self.points).max(initial=0)) + float(np.abs(centroids).max(initial=0))) * len(centroids[0])
        if self.cluster[:1] == -1:
            expired = np.arange(len(self.points))
        else:
            popped = []
            for heap, limit in zip(self.heaps, (used + slack).tolist()):
                while heap and heap[0][0] <= limit:
                    popped.append(heapq.heappop(heap)[1])
            expired = np.array(popped, dtype=np.int64)
        self.scanned = len(expired)
        if not len(expired):
            return
        away = blocks.squared(self.points[expired], centroids)
        near = away.argmin(axis=1)
        least = away[np.arange(len(near)), near]
        away[np.arange(len(near)), near] = np.inf
        gap = np.sqrt(away.min(axis=1)) - np.sqrt(least) + used[near]
        self.cluster[expired] = near
        for c, key, member in zip(near.tolist(), gap.tolist(), expired.tolist()):
            heapq.heappush(self.heaps[c], (key, member))

    def stored(self) -> dict:
        size = len(self.heaps)
        total = np.zeros((size, self.points.shape[1]), dtype=np.int64)
        np.add.at(total, self.cluster, self.points.astype(np.int64))
        entries = [e for heap in self.heaps for e in heap]
        return {
            "points": self.points, "cluster": self.cluster, "heap_sizes": np.array([len(h) for h in self.heaps], dtype=np.int32),
            "gaps": np.array([e[0] for e in entries]), "members": np.array([e[1] for e in entries], dtype=np.int32),
            "counts": np.bincount(self.cluster, minlength=size).tolist(), "sums": total.ravel().tolist(), "scanned": self.scanned,
        }

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        return ((self.points.astype(np.int64) - centroids[self.cluster]) ** 2).sum(axis=1)


def _first(centroids: np.ndarray):
    def work(rows: pa.Table) -> dict:
        block = Block(blocks.matrix(rows["x"], centroids.shape[1]), len(centroids))
        block.update(centroids, np.zeros(len(centroids)))
        return {"k": rows["k"], **block.stored()}

    return work


def _blocks(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[pa.Array, Block]]:
    state = batch.select([n for n in batch.schema.names if n != "k"])
    for i in range(batch.num_rows):
        row = {name: state.column(name)[i].as_py() for name in ("points", "cluster", "heap_sizes", "gaps", "members")}
        yield batch.column("k")[i].values, Block.read(row, dimension)


def _next(centroids: np.ndarray, used: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, block in _blocks(batch, centroids.shape[1]):
                block.update(centroids, used)
                yield blocks.one_row({"k": keys, **block.stored()})

    return run


def _last(centroids: np.ndarray, used: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, block in _blocks(batch, centroids.shape[1]):
                block.update(centroids, used)
                found = [keys, pa.array(block.cluster), pa.array(block.distances(centroids))]
                yield pa.RecordBatch.from_arrays(found, names=["k", "cluster", "distance"])

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Means of the clusters, rounded down; a cluster without vectors stays.  A row per centroid and component."""
    size, dimension = centroids.shape
    counted = state.select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    added = state.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
    counts, sums = np.zeros(size, dtype=np.int64), np.zeros(size * dimension, dtype=np.int64)
    for at, n in counted.collect():
        counts[at] = n
    for at, s in added.collect():
        sums[at] = s
    full = counts > 0
    out = centroids.copy()
    out[full] = sums.reshape(size, dimension)[full] // counts[full, None]
    return out


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much a gap of each cluster can have shrunk: its own way and the longest of the others."""
    way = np.sqrt(((new - old).astype(float) ** 2).sum(axis=1))
    others = [np.delete(way, j).max(initial=0) for j in range(len(way))]
    return way + np.array(others)


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 16, rounds: int = 3,
    dimension: int = 64, factor: int = FACTOR, seed: int = SEED,
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector kept.

    Kept are vectors of exactly ``dimension`` components, none NULL, NaN or infinite; components become ``floor(factor * x)``.
    Centroids start as the ``size`` kept vectors with the smallest SHA-256 of ``<seed>:<key>`` (a NULL key last, ties by
    components).  ``rounds`` times every vector goes to its nearest centroid (of equally near ones the lower number) and every
    centroid with vectors becomes their mean, rounded down; then vectors are assigned once more.  ``distance`` is the squared
    distance, ``cluster_inertia`` and ``inertia`` its sums.  Vectors with a component beyond what keeps distances
    exact (some ninety thousand before scaling) have NULL results.  Repeated rows count each, other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[key].alias("k"), blocks.floored(vectors[vector], factor).alias("x")).where(F.size("x") == dimension)
    fits = blocks.within(F.col("x"), dimension)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("k").cast("string")), 256)
    centroids = blocks.smallest(rows.where(fits).select(rank.alias("rank"), "x"), size).reshape(-1, dimension)
    kind = rows.schema["k"].dataType.simpleString()
    # What the vectors of each cluster may have lost of their gap since the start.
    used = np.zeros(len(centroids))
    results = f"k {kind}, cluster int, distance bigint"
    if len(centroids):
        state, folder = blocks.in_blocks(rows.where(fits), _first(centroids), f"k array<{kind}>, {_BLOCK}", "clusters")
        for number in range(rounds):
            moved = _moved(state, centroids)
            used, centroids = used + _drift(centroids, moved), moved
            if number < rounds - 1:
                old = folder
                state, folder = blocks.staged_blocks(state.mapInArrow(_next(centroids, used), state.schema), "clusters")
                drop_folder(spark, old)
        assigned = state.mapInArrow(_last(centroids, used), results)
    else:
        assigned = spark.createDataFrame([], results)
    found = stage(assigned, "assigned")
    per = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [
        (c, per[c], hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(per)
    ]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    inertia = F.lit(sum(per.values())).cast("bigint")
    # A row per centroid.
    told = found.join(F.broadcast(about), "cluster").select(
        F.col("k").alias(key), "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256"
    )
    nothing = {n: F.lit(None).cast(t) for n, t in told.dtypes if n != key}
    return told.unionByName(rows.where(~fits).select(F.col("k").alias(key), *[c.alias(n) for n, c in nothing.items()]))
