"""Micro-batch folders: output and state that can be written again after a failure.

Batch ``n`` writes ``<folder>/batch=<n>``, replacing what a failed attempt left,
and reads only folders of earlier batches, so every batch counts once.  State that is read over and over is
folded: every ``FOLD_EVERY`` batches all there is goes into ``<folder>/folded=<n>``, which counts once a marker file
in it says that it is whole.  Readers open the last whole fold and the batches after it; what the
fold before it held is deleted, so that a reader that has just begun loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loadlab.session import drop_folder

FOLD_EVERY = 16
MARKER = "_FOLDED"


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> tuple[list[int], list[int]]:
    """Batches and whole folds there are."""
    path, store = _path(spark, folder)
    if not store.exists(path):
        return [], []
    found: dict[str, list[int]] = {"batch": [], "folded": []}
    for entry in store.listStatus(path):
        kind, _, number = entry.getPath().getName().partition("=")
        if kind in found and number.isdigit():
            found[kind].append(int(number))
    folds = [n for n in found["folded"] if store.exists(_path(spark, f"{folder}/folded={n}/{MARKER}")[0])]
    return sorted(found["batch"]), sorted(folds)


def folders(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int | None, list[int]]:
    """The last whole fold and the batches after it, of those before batch ``before``."""
    batches, folds = _numbers(spark, folder)
    folds = [n for n in folds if before is None or n < before]
    last = folds[-1] if folds else None
    return last, [n for n in batches if (last is None or n > last) and (before is None or n < before)]


def read_parts(spark: SparkSession, folder: str, schema, before: int | None = None) -> DataFrame:
    """Rows of the last fold and of the batches after it, with ``batch``."""
    last, later = folders(spark, folder, before)
    rows = spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    if later:
        paths = [f"{folder}/batch={n}" for n in later]
        rows = spark.read.schema(schema).option("basePath", folder).parquet(*paths)
    if last is not None:
        rows = spark.read.schema(schema).parquet(f"{folder}/folded={last}").withColumn("batch", F.lit(last)).unionByName(rows)
    return rows


def fold(
    spark: SparkSession, folder: str, batch_id: int, schema, merge: Callable[[DataFrame], DataFrame] | None = None, every: int | None = None
) -> None:
    """Fold what there is up to ``batch_id`` if it is time to.  ``merge`` reduces rows with ``batch`` to rows of ``schema``."""
    if (batch_id + 1) % (every or FOLD_EVERY):
        return
    batches, folds = _numbers(spark, folder)
    if batch_id not in folds:
        parts = read_parts(spark, folder, schema, batch_id + 1)
        (merge(parts) if merge else parts.drop("batch")).write.mode("overwrite").parquet(f"{folder}/folded={batch_id}")
        marker, store = _path(spark, f"{folder}/folded={batch_id}/{MARKER}")
        store.create(marker, True).close()
    older = [n for n in folds if n < batch_id]
    for number in older[:-1]:
        drop_folder(spark, f"{folder}/folded={number}")
    for number in [n for n in batches if older and n <= older[-1]]:
        drop_folder(spark, f"{folder}/batch={number}")


def read_before(spark: SparkSession, folder: str, batch_id: int, schema) -> DataFrame:
    """Rows of all batches before ``batch_id``."""
    return read_parts(spark, folder, schema, batch_id).drop("batch")


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of an output that is never folded."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch")


def newest_rows(parts: DataFrame, keys: list[str], schema) -> DataFrame:
    """Each key's row of its last batch."""
    rest = [f.name for f in schema.fields if f.name not in keys]
    last = parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in schema.names])


def write_updates(updates: DataFrame, folder: str, checkpoint: str, keys: list[str] = ("ts",), **trigger) -> StreamingQuery:
    """Every batch's changed rows of an aggregation by ``keys``, the ones still open included."""
    schema, keys = updates.schema, list(keys)

    def process(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, folder, batch_id)
        fold(rows.sparkSession, folder, batch_id, schema, lambda parts: newest_rows(parts, keys, schema))

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(process).trigger(**(trigger or {"availableNow": True})).start()


def newest(spark: SparkSession, folder: str, keys: list[str], schema) -> DataFrame:
    """Of what :func:`write_updates` wrote, each key's row of its last batch."""
    return newest_rows(read_parts(spark, folder, schema), keys, schema)
