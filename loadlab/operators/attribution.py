"""Requests against the loadspec they were sent from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loadlab import fixed_values as fixed
from loadlab.functions.outcomes import DEFAULT_THROTTLE_CODES, counts_as_error, outcome


def request_rows(attempts: DataFrame) -> DataFrame:
    """The per-request report: one row per response.

    Server time and latency are kept for successful requests only; a request
    that failed in transport leaves no row.
    """
    answered = attempts.where(F.col("code").isNotNull())
    ok = F.col("code") == 200
    return answered.select(
        "ts",
        "code",
        *[F.when(ok, F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in ("took_in_millis", "latency_micros")],
        "id",
    )


def attribute(requests: DataFrame, loadspec: DataFrame) -> DataFrame:
    """Each request row with the URL and body it was made from.  ``id`` is
    unique on both sides, so the join keys spread evenly."""
    return requests.join(loadspec.select("id", "url", "source"), "id")


def unsent(loadspec: DataFrame, requests: DataFrame) -> DataFrame:
    """Loadspec entries without a request row: dropped in a pause or failed in transport."""
    return loadspec.join(requests.select("id"), "id", "left_anti")


def latency_by(
    requests: DataFrame, loadspec: DataFrame, by: str = "url", throttle_codes=DEFAULT_THROTTLE_CODES
) -> DataFrame:
    """Requests, errors and exact server-time quantiles per URL (or per query body).

    Equal (group, time, code) rows are counted before quantiles are taken, so a
    query that makes up a third of the load is a few thousand rows.
    """
    counted = attribute(requests, loadspec).groupBy(by, "code", "took_in_millis").agg(F.count("*").alias("_n"))
    ok = F.col("code") == 200
    error = counts_as_error(outcome(F.col("code"), throttle_codes))
    probabilities = F.array(*[F.lit(q) for q in fixed.QUANTILES])
    grouped = counted.groupBy(by).agg(
        F.sum("_n").alias("requests"),
        F.sum(F.when(error, F.col("_n")).otherwise(0)).alias("errors"),
        F.percentile(F.when(ok, F.col("took_in_millis")), probabilities, F.col("_n")).alias("_q"),
    )
    return grouped.select(
        by, "requests", "errors", *[F.col("_q")[i].alias(n) for i, n in enumerate(fixed.QUANTILE_NAMES)]
    )
