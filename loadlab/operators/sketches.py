"""Quantiles of stored ticks: a bounded sketch per tick that merges into longer ones.

A tick keeps a KLL sketch of its values.  Sketches of ticks merge to hours, days,
URLs or nodes without the rows behind them, in any order and on streams as in batch, and
hold some tens of kilobytes whatever they have seen.  A sketch of at most ``size``
values holds them all: its quantiles are exact.  Beyond that the rank of a quantile
differs from the one asked for by at most :func:`rank_error`, except with probability 1 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlab import fixed_values as fixed
from loadlab.operators.reports import gap_free, tick_end

SIZE = 2048


def rank_error(size: int = SIZE) -> float:
    """By how much the rank of a quantile can be off, as a share of all values."""
    return 2.296 / size**0.9021


def sketch(value: Column, size: int = SIZE) -> Column:
    """An aggregate: the sketch of the values that are not NULL."""
    return F.kll_sketch_agg_bigint(value, size)


def tick_sketches(
    rows: DataFrame,
    value: Column,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    keys: list[str] = (),
    size: int = SIZE,
    time: str = "ts",
) -> DataFrame:
    """``keys, ts, count, sketch`` per tick.  A row with NULL ``value`` is no sample, but its tick is there.

    Values are sketched in the tasks that read them, so a tick with a third of all rows is one sketch per task.
    """
    keys = list(keys)
    values = rows.select(*keys, tick_end(F.col(time), interval).alias("ts"), value.cast("bigint").alias("_value"))
    values = values.where(F.col("ts").isNotNull())
    return values.groupBy(*keys, "ts").agg(F.count("_value").alias("count"), sketch(F.col("_value"), size).alias("sketch"))


def merged(ticks: DataFrame, interval: int, keys: list[str] = ()) -> DataFrame:
    """``keys, ts, count, sketch`` of ticks of ``interval`` out of shorter ticks that it holds whole.

    Other keys of ``ticks`` are merged away.  Sketches must be of one size.
    """
    keys = list(keys)
    # A tick is named by its end, so what ends at the boundary belongs to the interval before it.
    longer = ticks.withColumn("ts", tick_end(F.col("ts") - 1, interval))
    return longer.groupBy(*keys, "ts").agg(F.sum("count").alias("count"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def quantiles(ticks: DataFrame, size: int = SIZE) -> DataFrame:
    """``ticks`` with quantiles instead of sketches, NULL without values, and ``exact``.

    A quantile is the smallest value with at least that share of values up to it.
    """
    found = [
        F.when(F.col("count") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(q))).alias(name)
        for q, name in zip(fixed.QUANTILES, fixed.QUANTILE_NAMES)
    ]
    rest = [c for c in ticks.columns if c != "sketch"]
    return ticks.select(*rest, *found, (F.col("count") <= size).alias("exact"))


def sketched_report(ticks: DataFrame, interval: int, size: int = SIZE) -> DataFrame:
    """The gap-free report ``ts, count, p50, p90, p99, p999`` out of stored ticks of that interval."""
    rows = gap_free(quantiles(ticks, size), interval)
    names = [F.col(q).cast("double").alias(q) for q in fixed.QUANTILE_NAMES]
    return rows.select("ts", F.coalesce("count", F.lit(0)).alias("count"), *names)


def outside(ticks: DataFrame, rows: DataFrame, value: Column, interval: int, size: int = SIZE, time: str = "ts") -> DataFrame:
    """``ts`` and how many of a tick's quantiles have a rank farther off than they may: a check against the rows themselves.

    Equal values share a range of ranks; a quantile is inside if any of them is near enough.
    """
    values = rows.select(tick_end(F.col(time), interval).alias("ts"), value.cast("bigint").alias("_value")).where("_value is not null")
    # Rows per tick and value, not rows, meet the few quantiles of their tick.
    counted = values.groupBy("ts", "_value").agg(F.count("*").alias("_n"))
    asked = quantiles(ticks, size).where("count > 0")
    below = [F.sum(F.when(F.col("_value") < F.col(q), F.col("_n")).otherwise(0)).alias(f"below_{q}") for q in fixed.QUANTILE_NAMES]
    upto = [F.sum(F.when(F.col("_value") <= F.col(q), F.col("_n")).otherwise(0)).alias(f"upto_{q}") for q in fixed.QUANTILE_NAMES]
    ranked = asked.join(counted, "ts").groupBy("ts", "count", "exact").agg(*below, *upto)
    may = F.when(F.col("exact"), 0.0).otherwise(rank_error(size)) * F.col("count")
    wrong = [
        ((F.col(f"below_{name}") >= q * F.col("count") + may) | (F.col(f"upto_{name}") < q * F.col("count") - may - 1e-6)).cast("int")
        for q, name in zip(fixed.QUANTILES, fixed.QUANTILE_NAMES)
    ]
    return ranked.select("ts", sum(wrong[1:], wrong[0]).cast("bigint").alias("outside"))
