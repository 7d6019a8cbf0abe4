"""Whole job: what came back from a load test to its report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loadlab import fixed_values as fixed
from loadlab.functions.outcomes import DEFAULT_THROTTLE_CODES
from loadlab.operators import attribution, reports, sequence
from loadlab.session import prepare, published, stage, staged_here
from loadlab.sources.writers import metric_path, write_metrics, write_requests


def report_series(
    attempts: DataFrame,
    node_stats: DataFrame | None = None,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    throttle_codes=DEFAULT_THROTTLE_CODES,
    approx: bool = False,
) -> dict[str, DataFrame]:
    """Every report series by file name.

    ``attempts``: ``id, ts, code, took_in_millis, latency_micros, pause_millis``
    with NULL code for transport failures; ``node_stats``: parsed polls.
    """
    prepare(attempts.sparkSession)
    ticks = reports.outcome_ticks(attempts, interval, throttle_codes, approx)
    running = {
        name: sequence.running_total(ticks, column, "value", position="_tick").select("ts", "value")
        for name, column in ((fixed.REQUESTS_SENT, "sent"), (fixed.ERRORS, "failed"))
    }
    series = {
        fixed.RESPONSE_TIME: reports.histogram_of(ticks, "took"),
        fixed.PAUSE_TIME: reports.histogram_of(ticks, "pause"),
        **running,
    }
    if node_stats is not None:
        columns = {
            f"{name}/{header}": (name, header, path)
            for name, (headers, paths) in fixed.NODE_SERIES.items()
            for header, path in zip(headers, paths)
        }
        # The newest poll of a node and tick, all its series; polls at the same time go by their values.
        newest = node_stats.groupBy("node_id", reports.tick_end(F.col("poll_ts"), interval).alias("ts")).agg(
            F.max_by("stats", F.struct("poll_ts", *[F.col(f"stats.{path}") for _, _, path in columns.values()])).alias("stats")
        )
        values = newest.select("node_id", "ts", *[F.col(f"stats.{path}").alias(c) for c, (_, _, path) in columns.items()])
        polled = stage(reports.carried(values, list(columns), interval, ["node_id"]), "node-ticks")
        for name in fixed.NODE_SERIES:
            own = [F.col(f"`{c}`").alias(header) for c, (of, header, _) in columns.items() if of == name]
            series[name] = polled.select("node_id", "ts", *own)
    return series


def write_reports(
    attempts: DataFrame,
    results_path: str,
    exp_id: str = "1",
    node_stats: DataFrame | None = None,
    interval: int = fixed.DEFAULT_INTERVAL_SECONDS,
    throttle_codes=DEFAULT_THROTTLE_CODES,
    approx: bool = False,
) -> None:
    """All series and the per-request rows as ``<name>_<exp_id>.csv``, all files or none.

    Files are written aside and appear when the last one is done; a job that fails leaves nothing, and
    none is replaced.  Attempts are read twice: for the series, and for the request rows.
    """
    if not results_path:
        raise ValueError("results_path can not be empty")
    spark = prepare(attempts.sparkSession)
    with staged_here(spark), published(spark, results_path) as aside:
        write_metrics(report_series(attempts, node_stats, interval, throttle_codes, approx), aside, exp_id)
        write_requests(attribution.request_rows(attempts), metric_path(aside, fixed.REQUEST, exp_id))
