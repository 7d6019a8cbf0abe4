"""Ticks on streams without a state store, and a place for what comes too late.

Each batch is aggregated by itself; its ticks merge with those of other batches when they are read.  So
every measure has two aggregates, one over rows and one over its own results.  A row whose tick had ended before
the latest time of earlier batches, less what may be late, goes to the late table; nothing is dropped unseen.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loadlab import fixed_values as fixed
from loadlab.operators import sketches
from loadlab.operators.reports import tick_end
from loadlab.session import stage
from loadlab.streaming.batches import fold, read_all, read_parts, write_batch

CLOCK = "latest bigint, arrived bigint, late bigint, untimed bigint"


class Measure(NamedTuple):
    """``of`` aggregates rows, ``merge`` the column that holds its results; ``kind`` is their type."""

    of: Column
    merge: Callable[[str], Column]
    kind: str = "bigint"


def histogram(value: Column, size: int = sketches.SIZE) -> dict[str, Measure]:
    """``count`` and a ``sketch`` of the values that are not NULL."""
    return {
        "count": Measure(F.count(value), F.sum),
        "sketch": Measure(sketches.sketch(value, size), F.kll_merge_agg_bigint, "binary"),
    }


def counter(name: str, condition: Column) -> dict[str, Measure]:
    return {name: Measure(F.count_if(condition), F.sum)}


def _schema(measures: dict[str, Measure]) -> str:
    return ", ".join(["ts bigint", *[f"`{name}` {m.kind}" for name, m in measures.items()]])


def _merged(ticks: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    return ticks.groupBy("ts").agg(*[m.merge(name).alias(name) for name, m in measures.items()])


def stream_ticks(
    stream: DataFrame,
    measures: dict[str, Measure],
    folder: str,
    checkpoint: str,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    allowed_seconds: int = 10,
    time: str = "ts",
    **trigger,
) -> StreamingQuery:
    """Aggregate rows by tick of ``time`` (seconds) below ``folder``, as they arrive.

    Rows without a time are counted and belong to no tick.
    """
    schema = _schema(measures)

    def process(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        arrived = stage(rows, "arrived")
        before = (None, 0, 0, 0)
        if batch_id:
            before = spark.read.schema(CLOCK).parquet(f"{folder}/clock/batch={batch_id - 1}").first()
        closed = None if before[0] is None else before[0] - allowed_seconds
        end = tick_end(F.col(time), interval)
        late = F.lit(False) if closed is None else F.coalesce(end <= closed, F.lit(False))
        write_batch(arrived.where(late), f"{folder}/late", batch_id)
        timely = arrived.where(~late & F.col(time).isNotNull())
        write_batch(timely.groupBy(end.alias("ts")).agg(*[m.of.alias(n) for n, m in measures.items()]), f"{folder}/ticks", batch_id)
        seen = arrived.agg(
            F.greatest(F.lit(before[0]).cast("bigint"), F.max(time)).cast("bigint"), F.count("*") + before[1],
            F.count_if(late) + before[2], F.count_if(F.col(time).isNull()) + before[3],
        )
        write_batch(seen.toDF("latest", "arrived", "late", "untimed"), f"{folder}/clock", batch_id)
        fold(spark, f"{folder}/ticks", batch_id, schema, lambda parts: _merged(parts, measures))

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ticks_so_far(spark: SparkSession, folder: str, measures: dict[str, Measure]) -> DataFrame:
    """``ts`` and the measures, a row per tick."""
    return _merged(read_parts(spark, f"{folder}/ticks", _schema(measures)), measures)


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that came after their tick was closed."""
    return read_all(spark, f"{folder}/late")


def arrivals_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """``latest, arrived, late, untimed``: one row, what has come so far."""
    clocks = spark.read.schema(f"{CLOCK}, batch int").option("basePath", f"{folder}/clock").parquet(f"{folder}/clock")
    return clocks.orderBy(F.col("batch").desc()).limit(1).drop("batch")
