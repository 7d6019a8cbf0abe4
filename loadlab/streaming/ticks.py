"""Report series on streams: event-time ticks.

Ticks are written as they change (:func:`loadlab.streaming.batches.write_updates`),
the current one too; a report is made when it is read, from each tick's newest
rows, gap-free and with the last tick as far as it has come.  A watermark only
bounds the state: what comes later than it allows is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlab import fixed_values as fixed
from loadlab.operators import sketches
from loadlab.operators.reports import carried, gap_free
from loadlab.operators.sequence import BLOCK_ROWS, running_total

DEFAULT_WATERMARK = "10 seconds"


def _windows(rows: DataFrame, time: str, interval: int, watermark: str):
    """Rows grouped by tick.  Spark drops rows that come later than the watermark allows."""
    return rows.withWatermark(time, watermark).groupBy(F.window(time, f"{interval} seconds").alias("_window"))


def _tick() -> Column:
    return F.unix_seconds("_window.end").alias("ts")


def histogram_ticks(
    rows: DataFrame,
    value: str,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    time: str = "time",
    watermark: str = DEFAULT_WATERMARK,
    approx: bool = False,
) -> DataFrame:
    """``ts, count, p50, p90, p99, p999`` of each tick; a NULL value is no sample, but its tick is there.

    Exact quantiles keep a tick's distinct values as state; ``approx`` keeps a sketch of
    bounded size (:mod:`loadlab.operators.sketches`), for whole-number values.
    """
    if approx:
        sketched = sketch_ticks(rows, value, interval, time, watermark)
        found = sketches.quantiles(sketched)
        return found.select("ts", "count", *[F.col(n).cast("double").alias(n) for n in fixed.QUANTILE_NAMES])
    digest = F.percentile(value, list(fixed.QUANTILES))
    ticks = _windows(rows, time, interval, watermark).agg(F.count(value).alias("count"), digest.alias("_q"))
    return ticks.select(
        _tick(), "count", *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(fixed.QUANTILE_NAMES)]
    )


def sketch_ticks(
    rows: DataFrame,
    value: str,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    time: str = "time",
    watermark: str = DEFAULT_WATERMARK,
    size: int = sketches.SIZE,
) -> DataFrame:
    """``ts, count, sketch`` of each tick: stored, they merge to longer ones (:func:`loadlab.operators.sketches.merged`)."""
    whole = F.col(value).cast("bigint")
    ticks = _windows(rows, time, interval, watermark).agg(F.count(whole).alias("count"), sketches.sketch(whole, size).alias("sketch"))
    return ticks.select(_tick(), "count", "sketch")


def counter_ticks(
    rows: DataFrame,
    condition: Column,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    time: str = "time",
    watermark: str = DEFAULT_WATERMARK,
) -> DataFrame:
    """``ts, n``: rows of each tick for which ``condition`` holds."""
    return _windows(rows, time, interval, watermark).agg(F.count_if(condition).alias("n")).select(_tick(), "n")


def gauge_ticks(
    rows: DataFrame,
    values: list[str],
    newest: Column,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    time: str = "time",
    watermark: str = DEFAULT_WATERMARK,
) -> DataFrame:
    """``ts`` and the last polled ``values`` of each tick; ``newest`` orders polls and must not tie."""
    ticks = _windows(rows, time, interval, watermark).agg(F.max_by(F.struct(*values), newest).alias("_last"))
    return ticks.select(_tick(), *[F.col(f"_last.{v}").alias(v) for v in values])


def histogram_so_far(ticks: DataFrame, interval: int = fixed.DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    """The report out of :func:`histogram_ticks`, one row per tick."""
    return gap_free(ticks, interval).select("ts", F.coalesce("count", F.lit(0)).alias("count"), *fixed.QUANTILE_NAMES)


def counter_so_far(ticks: DataFrame, interval: int = fixed.DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    """Running totals out of :func:`counter_ticks`, one row per tick."""
    filled = gap_free(ticks, interval).select("_tick", "ts", F.coalesce("n", F.lit(0)).alias("n"))
    return running_total(filled, "n", "value", position="_tick", block_rows=BLOCK_ROWS).select("ts", "value")


def gauges_so_far(ticks: DataFrame, values: list[str], interval: int = fixed.DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    """Last values out of :func:`gauge_ticks`, one row per tick, carried over ticks without a poll."""
    return carried(ticks, values, interval)
