"""Report series: one row per tick of fixed length, without gaps.

A tick covers ``k * interval <= t < (k + 1) * interval`` in seconds since the
epoch and is named by its end, ``ts = (k + 1) * interval``, the time at which it
can be reported.  Raw rows are aggregated map-side per
tick; everything after that works on tick rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlab import fixed_values as fixed
from loadlab.functions.outcomes import DEFAULT_THROTTLE_CODES, counts_as_error, outcome
from loadlab.operators.sequence import BLOCK_ROWS, carry_forward, running_total, unfold
from loadlab.session import stage

APPROX_ACCURACY = 10_000


def tick_end(seconds: Column, interval: int) -> Column:
    step = F.lit(interval).cast("bigint")
    return seconds - F.pmod(seconds, step) + step


def gap_free(per_tick: DataFrame, interval: int, keys: list[str] = ()) -> DataFrame:
    """Tick rows with ``_tick``, their number from the first tick on, per ``keys``;
    ticks without a row get NULLs.

    The tick rows are staged, so the raw rows behind them are read once and not
    again for the first and last tick.
    """
    keys = list(keys)
    ticks = stage(per_tick, "ticks")
    ends = ticks.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    spanned = ends.where(F.col("_first").isNotNull())
    spine = unfold(spanned, F.expr(f"(_last - _first) div {interval} + 1"), "_tick", keys)
    spine = spine.select(*keys, "_tick", (F.col("_first") + F.col("_tick") * interval).alias("ts"))
    return spine.join(ticks, [*keys, "ts"], "left")


def histogram_report(
    rows: DataFrame,
    value: Column,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    approx: bool = False,
    time: str = "ts",
) -> DataFrame:
    """Count and quantiles of ``value`` per tick; a tick without values has count
    0 and NULL quantiles.  A row with NULL ``value`` is no sample, but its tick
    is part of the report.

    Exact quantiles first count equal values, so what reaches one task per tick
    is its distinct values (milliseconds below the request timeout), not its
    rows.  ``approx`` keeps a bounded digest instead, for values without such a
    bound.
    """
    values = rows.select(tick_end(F.col(time), interval).alias("ts"), value.alias("_value"))
    probabilities = F.array(*[F.lit(q) for q in fixed.QUANTILES])
    if approx:
        ticks = values.groupBy("ts").agg(
            F.count("_value").alias("count"),
            F.percentile_approx("_value", list(fixed.QUANTILES), APPROX_ACCURACY).alias("_q"),
        )
    else:
        equal = values.groupBy("ts", "_value").agg(F.count("*").alias("_n"))
        ticks = equal.groupBy("ts").agg(
            F.sum(F.when(F.col("_value").isNotNull(), F.col("_n"))).alias("count"),
            F.percentile("_value", probabilities, F.col("_n")).alias("_q"),
        )
    quantiles = [F.col("_q")[i].cast("double").alias(name) for i, name in enumerate(fixed.QUANTILE_NAMES)]
    return gap_free(ticks, interval).select("ts", F.coalesce("count", F.lit(0)).alias("count"), *quantiles)


def tick_counts(
    rows: DataFrame, counts: dict[str, Column], interval: int = fixed.DEFAULT_INTERVAL_SECONDS, time: str = "ts"
) -> DataFrame:
    """Rows per tick for which each condition holds, gap-free."""
    per_tick = rows.groupBy(tick_end(F.col(time), interval).alias("ts")).agg(
        *[F.count_if(condition).alias(name) for name, condition in counts.items()]
    )
    filled = [F.coalesce(name, F.lit(0)).alias(name) for name in counts]
    return gap_free(per_tick, interval).select("_tick", "ts", *filled)


def counter_report(
    rows: DataFrame, condition: Column, interval: int = fixed.DEFAULT_INTERVAL_SECONDS, time: str = "ts"
) -> DataFrame:
    """Running number of rows for which ``condition`` holds, at the end of each tick."""
    ticks = tick_counts(rows, {"_n": condition}, interval, time)
    return running_total(ticks, "_n", "value", position="_tick", block_rows=BLOCK_ROWS).select("ts", "value")


def outcome_ticks(
    attempts: DataFrame,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    throttle_codes=DEFAULT_THROTTLE_CODES,
    approx: bool = False,
) -> DataFrame:
    """What the reports of a load test need per tick, out of one pass over its attempts; gap-free and staged.

    ``_tick, ts, sent, failed`` and, of server time (``took``) and pauses (``pause``), ``<name>_count`` and an array
    of quantiles ``<name>_q``.  Exact quantiles first count equal rows, of which a tick has as many as different
    times and pauses; ``approx`` keeps a sketch of bounded size (:mod:`loadlab.operators.sketches`).
    """
    from loadlab.operators import sketches

    kind = outcome(F.col("code"), throttle_codes)
    rows = attempts.select(
        tick_end(F.col("ts"), interval).alias("ts"),
        F.when(F.col("code") == 200, F.col("took_in_millis")).alias("took"),
        F.when(kind == "throttled", F.col("pause_millis")).alias("pause"),
        counts_as_error(kind).alias("failed"),
    )
    values = ("took", "pause")
    if approx:
        counted = [F.count(v).alias(f"{v}_count") for v in values] + [sketches.sketch(F.col(v)).alias(f"{v}_s") for v in values]
        ticks = rows.groupBy("ts").agg(F.count("*").alias("sent"), F.count_if("failed").alias("failed"), *counted)
        quantiles = [
            F.when(F.col(f"{v}_count") > 0, F.kll_sketch_get_quantile_bigint(f"{v}_s", F.array(*map(F.lit, fixed.QUANTILES)))).alias(f"{v}_q")
            for v in values
        ]
        ticks = ticks.select("ts", "sent", "failed", *[f"{v}_count" for v in values], *quantiles)
    else:
        equal = rows.groupBy("ts", *values).agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
        probabilities = F.array(*map(F.lit, fixed.QUANTILES))
        counted = [F.sum(F.when(F.col(v).isNotNull(), F.col("n"))).alias(f"{v}_count") for v in values]
        quantiles = [F.percentile(v, probabilities, F.col("n")).alias(f"{v}_q") for v in values]
        ticks = equal.groupBy("ts").agg(F.sum("n").alias("sent"), F.sum("failed").alias("failed"), *counted, *quantiles)
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("sent", "failed", *[f"{v}_count" for v in values])]
    return stage(gap_free(ticks, interval).select("_tick", "ts", *filled, *[f"{v}_q" for v in values]), "outcome-ticks")


def histogram_of(ticks: DataFrame, value: str) -> DataFrame:
    """The report ``ts, count, p50, p90, p99, p999`` of ``took`` or ``pause`` out of :func:`outcome_ticks`."""
    quantiles = [F.col(f"{value}_q")[i].cast("double").alias(name) for i, name in enumerate(fixed.QUANTILE_NAMES)]
    return ticks.select("ts", F.col(f"{value}_count").alias("count"), *quantiles)


def requests_sent_report(attempts: DataFrame, interval: int = fixed.DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    return counter_report(attempts, F.lit(True), interval)


def errors_report(
    attempts: DataFrame, interval: int = fixed.DEFAULT_INTERVAL_SECONDS, throttle_codes=DEFAULT_THROTTLE_CODES
) -> DataFrame:
    return counter_report(attempts, counts_as_error(outcome(F.col("code"), throttle_codes)), interval)


def response_time_report(attempts: DataFrame, interval: int = fixed.DEFAULT_INTERVAL_SECONDS, approx: bool = False) -> DataFrame:
    """Server-side time of successful requests."""
    return histogram_report(attempts, F.when(F.col("code") == 200, F.col("took_in_millis")), interval, approx)


def pause_report(
    attempts: DataFrame,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    throttle_codes=DEFAULT_THROTTLE_CODES,
    approx: bool = False,
) -> DataFrame:
    """Pauses asked for by throttled responses (``pause_millis``)."""
    throttled = outcome(F.col("code"), throttle_codes) == "throttled"
    return histogram_report(attempts, F.when(throttled, F.col("pause_millis")), interval, approx)


def throughput_report(
    attempts: DataFrame, interval: int = fixed.DEFAULT_INTERVAL_SECONDS, throttle_codes=DEFAULT_THROTTLE_CODES
) -> DataFrame:
    """Requests and errors per second in each tick."""
    error = counts_as_error(outcome(F.col("code"), throttle_codes))
    ticks = tick_counts(attempts, {"_sent": F.lit(True), "_errors": error}, interval)
    return ticks.select(
        "ts", (F.col("_sent") / interval).alias("requests_per_sec"), (F.col("_errors") / interval).alias("errors_per_sec")
    )


def untimed(rows: DataFrame, time: str = "ts") -> DataFrame:
    """Rows without a time, which belong to no tick and are in no report."""
    return rows.where(F.col(time).isNull())


def status_summary(attempts: DataFrame, throttle_codes=DEFAULT_THROTTLE_CODES) -> DataFrame:
    """Requests per status code and outcome."""
    return attempts.groupBy("code", outcome(F.col("code"), throttle_codes).alias("outcome")).agg(
        F.count("*").alias("requests")
    )


def gauge_report(
    polls: DataFrame,
    values: list[str],
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    time: str = "ts",
    newest: Column | None = None,
    keys: list[str] = (),
) -> DataFrame:
    """Last polled values per tick, carried over ticks without a poll, per ``keys``.

    ``newest`` orders the polls inside a tick (default: ``time``) and must not tie.
    """
    keys = list(keys)
    per_tick = polls.groupBy(*keys, tick_end(F.col(time), interval).alias("ts")).agg(
        F.max_by(F.struct(*values), F.col(time) if newest is None else newest).alias("_last")
    )
    return carried(per_tick.select(*keys, "ts", *[F.col(f"_last.{v}").alias(v) for v in values]), values, interval, keys)


def carried(per_tick: DataFrame, values: list[str], interval: int, keys: list[str] = ()) -> DataFrame:
    """Values per tick, each carried over ticks without one, 0 before the first."""
    keys = list(keys)
    quoted = [f"`{v}`" for v in values]
    ticks = gap_free(per_tick, interval, keys).select(*keys, "ts", "_tick", *quoted)
    filled = carry_forward(ticks, values, "_tick", BLOCK_ROWS, keys)
    return filled.select(*keys, "ts", *[F.coalesce(q, F.lit(0)).alias(v) for q, v in zip(quoted, values)])
