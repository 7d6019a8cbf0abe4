"""Row shapes shared by readers, operators and writers."""

from __future__ import annotations

LOADSPEC = "id BIGINT, delay_since_last_nanos BIGINT, url STRING, source STRING"

REQUEST = "ts BIGINT, code INT, took_in_millis BIGINT, latency_micros BIGINT, id BIGINT"

PSEUDONYMS = "field STRING, key STRING, anon STRING"

_POOL = "STRUCT<used_in_bytes: BIGINT, max_in_bytes: BIGINT>"
_MEMORY = "STRUCT<used_in_bytes: BIGINT, total_in_bytes: BIGINT>"
_COLLECTOR = "STRUCT<collection_count: BIGINT, collection_time_in_millis: BIGINT>"

# Only the members the metric series need; from_json skips everything else.
NODE = f"""STRUCT<
  timestamp: BIGINT,
  jvm: STRUCT<
    mem: STRUCT<
      heap_used_in_bytes: BIGINT, heap_committed_in_bytes: BIGINT,
      non_heap_used_in_bytes: BIGINT, non_heap_committed_in_bytes: BIGINT,
      pools: STRUCT<young: {_POOL}, old: {_POOL}, survivor: {_POOL}>>,
    gc: STRUCT<collectors: STRUCT<young: {_COLLECTOR}, old: {_COLLECTOR}>>>,
  os: STRUCT<mem: {_MEMORY}, swap: {_MEMORY}>,
  process: STRUCT<cpu: STRUCT<percent: BIGINT, total_in_millis: BIGINT>>>"""

POLL_BODY = f"nodes MAP<STRING, {NODE}>"
