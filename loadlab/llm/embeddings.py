"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine, components.

Equal vectors of one label are one class.  In each of ``TABLES`` tables a class
falls into the bucket of the signs of its products with ``BITS`` random
directions; two vectors at cosine 0.93 agree in a table with probability 0.13,
at 0.95 with 0.18, so a pair at 0.93 is missed in about 1 of 700 cases, at 0.95 in 1 of 9,000.
Buckets are compared in blocks of ``BLOCK`` rows, a matrix product in double
precision for each pair of blocks; a pair counts in the first table it shares.
Tasks return counts per vector and links enough to connect what is
connected, never the list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadlab.llm.graph import components, lowest
from loadlab.llm.groups import per_group
from loadlab.session import stage

BITS = 16
TABLES = 48
BLOCK = 256
SEED = 5


def _directions(dimension: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension]).standard_normal((dimension, TABLES * BITS))


def signatures(vectors: np.ndarray) -> np.ndarray:
    """``(vectors, TABLES)`` bucket numbers."""
    signs = (vectors @ _directions(vectors.shape[1]) > 0).reshape(len(vectors), TABLES, BITS)
    return (signs * (1 << np.arange(BITS))).sum(axis=2).astype(np.uint16)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("vector").to_pylist()
        bits = np.empty((len(rows), TABLES), dtype=np.uint16)
        lengths = np.array([len(r) for r in rows])
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            bits[at] = signatures(np.array([rows[i] for i in at], dtype=float))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("rep"),
                batch.column("space"),
                pa.array([np.asarray(r, dtype=float).tobytes() for r in rows], pa.binary()),
                pa.array([b.tobytes() for b in bits], pa.binary()),
            ],
            names=["rep", "space", "vector", "signature"],
        )


def _compare(threshold: float):
    def of(table: pa.Table):
        vectors = np.frombuffer(b"".join(table["vector"].to_pylist()), dtype=float).reshape(table.num_rows, -1)
        # Scaled by the largest component first, so that no square over- or underflows.
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        bits = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint16).reshape(table.num_rows, TABLES)
        return table["rep"].to_numpy(), table["copies"].to_numpy(), vectors, bits

    def work(group: pa.Table) -> pa.Table | None:
        number = group["table"][0].as_py()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        block = group["block"].to_numpy()
        left = of(group.filter(pa.array(block == i)))
        right = left if i == j else of(group.filter(pa.array(block == j)))
        if not len(left[0]) or not len(right[0]):
            return None
        close = left[2] @ right[2].T >= threshold
        if i == j:
            close &= np.tri(len(left[0]), k=-1, dtype=bool).T
        a, b = np.nonzero(close)
        first = (left[3][a] == right[3][b]).argmax(axis=1) == number
        a, b = a[first], b[first]
        if not len(a):
            return None
        ids = np.concatenate([left[0][a], right[0][b]])
        times = np.concatenate([right[1][b], left[1][a]])
        vertices, at = np.unique(ids, return_inverse=True)
        counted = np.bincount(at, weights=times).astype(np.int64)
        # Links that connect: everyone with the smallest of his component here.
        low = lowest(at[: len(a)], at[len(a) :], len(vertices))
        nothing = np.zeros(len(vertices), dtype=np.int64)
        return pa.table(
            {"a": np.concatenate([vertices, vertices]), "b": np.concatenate([vertices, vertices[low]]), "n": np.concatenate([counted, nothing])}
        )

    return work


def near_embeddings(
    vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Rows of the same label (not NULL) are linked if the cosine of their vectors is at
    least ``threshold``.  Vectors that are NULL or empty, of length zero, or with a NULL, NaN
    or infinite component are linked with nothing, nor are vectors of different dimension.
    Repeated rows are linked with one another like any equal vectors; a row with a NULL
    key is linked with nothing.  Other columns are not read.
    """
    read = vectors.select(
        vectors[key].cast("bigint").alias("k"), vectors[vector].cast("array<double>").alias("vector"), vectors[label].alias("label")
    )
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(sound & F.col("label").isNotNull() & F.col("k").isNotNull(), F.lit(False))
    # Label and dimension: what is compared with what.
    space = F.xxhash64(F.col("label").cast("string"), F.size("vector"))
    h = [F.xxhash64(F.lit(i), F.col("label").cast("string"), F.col("vector")) for i in (1, 2)]
    rows = stage(
        read.select("k", usable.alias("usable"), space.alias("space"), h[0].alias("h1"), h[1].alias("h2"), "vector"), "vectors"
    )
    same = ["h1", "h2"]
    sound_rows = rows.where("usable")
    classes = stage(sound_rows.groupBy(*same).agg(F.min("k").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = sound_rows.join(classes.select("rep"), F.col("k") == F.col("rep"), "left_semi").dropDuplicates(same)
    reps = reps.join(classes, same).select("rep", "space", "vector", "copies")
    hashed = reps.select("rep", "space", "vector").mapInArrow(_hashed, "rep bigint, space bigint, vector binary, signature binary")
    hashed = stage(hashed, "signatures")

    sign = F.expr("substring(signature, 2 * table + 1, 2)")
    in_tables = hashed.select("rep", "space", "signature", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("table"))
    in_tables = in_tables.select("rep", "table", F.xxhash64("space", "table", sign).alias("bucket"))
    buckets = in_tables.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("m"))
    shared = in_tables.join(buckets.where("m > 1").drop("m"), "bucket")
    shared = shared.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = shared.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("rep", "table", "bucket", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    full = hashed.join(classes.select("rep", "copies").dropDuplicates(["rep"]), "rep")
    compared = per_group(pairs.join(full, "rep"), ["bucket", "i", "j"], _compare(threshold), "a bigint, b bigint, n bigint")
    compared = stage(compared, "compared")

    counts = compared.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    found = components(compared).withColumnRenamed("id", "rep")
    of_class = classes.join(counts, "rep", "left").join(found, "rep", "left").select(
        *same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    joined = rows.select("k", "usable", *same).join(of_class, same, "left")
    links = F.when(F.col("usable"), F.col("n_links")).otherwise(0)
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("k"))
    return joined.select(
        F.col("k").alias(key), links.alias("n_links"), component.alias("component_id"),
        (component.isNull() | (component == F.col("k"))).alias("kept"),
    )
