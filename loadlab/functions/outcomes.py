"""Columns about what came back for a request."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_THROTTLE_CODES = (429, 503)


def outcome(code: Column, throttle_codes=DEFAULT_THROTTLE_CODES) -> Column:
    """``ok``, ``throttled``, ``client_error``, ``error`` or (no code) ``transport``."""
    return (
        F.when(code.isNull(), "transport")
        .when(code == 200, "ok")
        .when(code.isin(*throttle_codes), "throttled")
        .when(code.between(400, 499), "client_error")
        .otherwise("error")
    )


def counts_as_error(kind: Column) -> Column:
    """Throttled requests are pauses, not errors."""
    return kind.isin("transport", "client_error", "error")


def latency_micros(nanos: Column) -> Column:
    return F.call_function("div", nanos, F.lit(1000))


def retry_after_millis(header: Column) -> Column:
    """``Retry-After`` seconds, possibly fractional, as whole milliseconds."""
    return (header.try_cast("double") * F.lit(1e3)).cast("bigint")


def took_millis(body: Column) -> Column:
    """Server-side time of a search response."""
    return F.get_json_object(body, "$.took").try_cast("bigint")


def error_type(body: Column) -> Column:
    return F.get_json_object(body, "$.error.type")


def error_reason(body: Column) -> Column:
    return F.get_json_object(body, "$.error.reason")


def hits_total(body: Column) -> Column:
    """Number of matching documents in a search response."""
    return F.get_json_object(body, "$.hits.total").try_cast("bigint")
