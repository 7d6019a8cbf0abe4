"""Node metric series out of stored node-stats polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loadlab import fixed_values as fixed, schemas


def parse_polls(polls: DataFrame, body: str = "body", poll_ts: str | None = None) -> DataFrame:
    """One row per poll and node: ``poll_ts`` (seconds), ``node_id``, ``stats``.

    Without a ``poll_ts`` column the node's own timestamp (milliseconds) counts.
    All nodes of a poll are kept.
    """
    parsed = polls.withColumn("_nodes", F.from_json(body, schemas.POLL_BODY)["nodes"])
    kept = [poll_ts] if poll_ts else []
    # An outer explode is not preceded by a size check that would parse the body again.
    nodes = parsed.select(*kept, F.explode_outer("_nodes").alias("node_id", "stats")).where("node_id is not null")
    seconds = F.col(poll_ts) if poll_ts else F.expr("stats.timestamp div 1000")
    return nodes.select(seconds.cast("bigint").alias("poll_ts"), "node_id", "stats")


def unreadable_polls(polls: DataFrame, body: str = "body") -> DataFrame:
    """Polls without a readable list of nodes, which :func:`parse_polls` leaves out."""
    found = F.from_json(body, schemas.POLL_BODY)["nodes"]
    return polls.where(found.isNull() | (F.size(found) == 0))


def series(nodes: DataFrame, name: str) -> DataFrame:
    """One metric series under its report column names."""
    headers, paths = fixed.NODE_SERIES[name]
    return nodes.select(
        "poll_ts", "node_id", *[F.col(f"stats.{path}").alias(header) for header, path in zip(headers, paths)]
    )


def all_series(nodes: DataFrame) -> DataFrame:
    """Every series in one pass: ``poll_ts, node_id, series, metric, value``."""
    entries = [
        F.struct(F.lit(name).alias("series"), F.lit(header).alias("metric"), F.col(f"stats.{path}").alias("value"))
        for name, (headers, paths) in fixed.NODE_SERIES.items()
        for header, path in zip(headers, paths)
    ]
    return nodes.select("poll_ts", "node_id", F.inline(F.array(*entries)))
