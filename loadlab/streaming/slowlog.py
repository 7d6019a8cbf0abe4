"""Slow-log lines parsed as they arrive.  Parsing keeps no state; sequencing needs
the whole log and is a batch job over what this writes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loadlab.operators import requests


def parsed_requests(lines: DataFrame, server: str | None = None) -> DataFrame:
    """Replayable requests with URL and body of a stream of lines."""
    return requests.with_url(requests.replayable(lines), server)


def rejected_lines(lines: DataFrame) -> DataFrame:
    return requests.rejects(lines)
