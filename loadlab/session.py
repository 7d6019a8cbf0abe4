"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Of rows that go to Python at a time: long texts would make 10,000 rows of any size.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Set the SQL options results depend on, and what a Python worker is handed at a time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A repeated JSON key keeps its last value instead of making the body invalid.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own; on a cluster the setting is required.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="loadlab-"))
    return context.getCheckpointDir()


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loadlab/{spark.sparkContext.applicationId}"


#: Folders of the jobs that remove what they stage, innermost last.
_scopes: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    below = _scopes[-1] if _scopes else _own_dir(spark)
    return f"{below}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the store, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete everything this application staged; results read from it are gone as well."""
    drop_folder(spark, _own_dir(spark))


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go now: Spark deletes them once the driver collects their plans, which may be long after."""
    spark._jvm.System.gc()


@contextmanager
def staged_here(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go when the job ends; its results must be written by then."""
    _scopes.append(f"{_own_dir(spark)}/job-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        drop_folder(spark, _scopes.pop())


@contextmanager
def published(spark: SparkSession, folder: str) -> Iterator[str]:
    """A folder beside the others of ``folder`` to write to; what lies in it goes to ``folder`` when all is written.

    Nothing that is there is replaced.  If anything fails, what was written and what had moved goes.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{folder.rstrip('/')}/_unpublished-{uuid.uuid4().hex}"
    moved = []
    try:
        yield aside
        targets = [(entry.getPath(), path(path(folder), entry.getPath().getName())) for entry in store.listStatus(path(aside))]
        there = [target.toString() for _, target in targets if store.exists(target)]
        if there:
            raise FileExistsError(f"already there: {there}")
        for source, target in targets:
            if not store.rename(source, target):
                raise OSError(f"could not publish {target.toString()}")
            moved.append(target)
    except BaseException:
        for target in moved:
            store.delete(target, True)
        raise
    finally:
        store.delete(path(aside), True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    This cuts the lineage so a lost executor costs a re-read, not a recompute,
    pins values that depend on partitioning, and (unlike a row checkpoint) lets
    later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, texts: list[str]) -> bool:
    """Whether a table, mostly made up of the string columns ``texts``, is proven
    small enough to be sent to every executor.  Counting it is one narrow pass."""
    used = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0))
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(used), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES
