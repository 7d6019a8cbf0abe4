"""Whole jobs that make a loadspec: ``id, delay_since_last_nanos, url, source``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation

from loadlab import fixed_values as fixed
from loadlab.operators import arrivals, requests, sequence
from loadlab.session import prepare, stage
from loadlab.sources.readers import LINE_ORDER

COLUMNS = ["id", "delay_since_last_nanos", "url", "source"]


def from_slowlog(
    lines: DataFrame,
    server: str | None = None,
    indexes: list[str] = (),
    max_duration_seconds: float = 0,
    pseudonymise=None,
    order: list[str] = ("ord",),
    keep: list[str] = (),
    fail_on_reject: bool = False,
    observed: Observation | None = None,
    max_reject_share: float | None = None,
) -> DataFrame:
    """Slow-log lines to a replayable loadspec that keeps the arrival times.

    ``lines`` has ``value`` and the ``order`` columns that identify a line in
    input order (ties in time keep it).  ``server`` replaces the logged host,
    ``indexes`` the logged index in turn (for lines just read, ``order=LINE_ORDER``, without a sort); ``pseudonymise`` maps the request rows
    (JSON in ``body``) before they are sequenced.  ``keep`` carries further
    columns of ``lines`` along.  Invalid lines are left out (see
    :func:`loadlab.operators.requests.rejects`) or, with ``fail_on_reject``,
    stop the job.

    ``observed`` gets the counts of :func:`loadlab.operators.requests.observe` on the way, without a
    second reading; with ``max_reject_share`` a larger share of invalid lines stops the job before anything is sorted.
    """
    prepare(lines.sparkSession)
    order, keep = list(order), [c for c in keep if c not in order]
    max_nanos = int(max_duration_seconds * fixed.NANOS)

    if max_reject_share is not None and observed is None:
        observed = Observation()
    if fail_on_reject or observed is not None:
        checked = requests.parse_lines(lines)
        if observed is not None:
            checked = requests.observe(checked, observed)
        if fail_on_reject:
            checked = requests.fail_on_reject(checked)
        parsed = checked.where(checked["reason"].isNull())
    else:
        parsed = requests.replayable(lines)
    needed = parsed.select(*order, *keep, "ts_nanos", "host", "index", "types", "search_type", "body")
    # Lines as they were read from files know their place; they are numbered where they lie, while they are staged.
    in_place = bool(indexes) and order == LINE_ORDER
    if in_place:
        rows = requests.override_index(needed, list(indexes), block=LINE_ORDER[:2])
    else:
        # Lines are matched once; sampling, cutting and sorting then read columns.
        rows = stage(needed, "requests")
    if max_reject_share is not None:
        requests.check_share(observed.get, max_reject_share)
    if indexes and not in_place:
        rows = requests.override_index(rows, list(indexes), order)
    if pseudonymise is not None:
        rows = stage(pseudonymise(rows), "pseudonymised")
    rows = sequence.cut_at_duration(requests.with_url(rows, server), max_nanos)
    wide = rows.select(*order, *keep, "ts_nanos", "url", rows["body"].alias("source"))
    ordered = sequence.arrival_delays(wide, tie_break=order)
    return sequence.cut_ordered(ordered, max_nanos).select(*keep, *[c for c in order if c not in keep], *COLUMNS)


def duration_nanos(loadspec: DataFrame) -> DataFrame:
    """Length of the test: the sum of all delays."""
    return loadspec.selectExpr("sum(delay_since_last_nanos) as duration_nanos", "count(*) as requests")


def synthetic(
    spark,
    template: str,
    url: str,
    arrival_spec: str,
    duration_seconds: float,
    dictionary: DataFrame | None = None,
    seed: int = 0,
) -> DataFrame:
    """One query template repeated over a constant or Poisson arrival process."""
    prepare(spark)
    kind, processes = arrivals.process(spark, arrival_spec, duration_seconds)
    timed = arrivals.arrivals(kind, processes, seed)
    return arrivals.with_bodies(timed, template, url, dictionary, seed)
