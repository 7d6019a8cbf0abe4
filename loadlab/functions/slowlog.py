"""Slow-log line columns: field extraction, log time, request URL."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, functions as F

from loadlab import fixed_values as fixed

FIELDS = ("ts", "log_type", "host", "index", "types", "search_type", "source")

# Literals every matching line holds.
_MARKS = ("types[", "stats", "search_type[", "source[", "], extra_source")

# Stands between the groups of one match; lines that hold it are matched group by group.
_BETWEEN = "\x01"


def _locate(mark: str, line: Column, start: Column) -> Column:
    return F.call_function("locate", F.lit(mark), line, start)


def marks(line: Column) -> Column:
    """Where the middle and the last part begin (0 if absent): ``types_at, search_at``."""
    return F.struct(
        _locate("types[", line, F.lit(1)).alias("types_at"), _locate("search_type[", line, F.lit(1)).alias("search_at")
    )


def _groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of the first match from one pass over the text."""
    joined = _BETWEEN.join(f"${group}" for group in range(1, count + 1))
    whole = f"{fixed.UNIX_LINES}^.*?{pattern}.*$"
    return F.split(F.regexp_replace(text, whole, joined), _BETWEEN)


def groups(line: Column, types_at: Column, search_at: Column) -> Column:
    """The seven fields as an array; of another length, or NULL, if the line does not match.

    The header before ``types[`` and the part before ``search_type[`` are short.
    When both markers occur once, matching the three parts apart gives the same
    groups as matching the whole line, without letting ``.*`` in the header
    wander through a large query body (seconds per line on a body with a few
    hundred brackets).  Other lines take the whole pattern, if they hold every
    literal of it.
    """
    simple = (
        (types_at > 0)
        & (search_at > types_at)
        & (_locate("types[", line, types_at + 1) == 0)
        & (_locate("search_type[", line, search_at + 1) == 0)
        & ~F.contains(line, F.lit(_BETWEEN))
    )
    apart = F.concat(
        _groups(F.substring(line, F.lit(1), types_at - 1), fixed.SLOWLOG_HEAD, 4),
        _groups(F.substring(line, types_at, search_at - types_at), fixed.SLOWLOG_MIDDLE, 1),
        _groups(F.substring(line, search_at, F.length(line)), fixed.SLOWLOG_TAIL, 2),
    )
    matchable = F.lit(True)
    for mark in _MARKS:
        matchable = matchable & F.contains(line, F.lit(mark))
    whole = F.array(
        *[F.regexp_extract(line, fixed.UNIX_LINES + fixed.SLOWLOG_LINE, i) for i in range(1, len(FIELDS) + 1)]
    )
    return F.when(simple, apart).when(matchable, whole)


def fields(found: Column) -> Column:
    """The seven fields by name; NULL where the line does not match."""
    complete = (F.size(found) == len(FIELDS)) & (found[0] != "")
    return F.struct(*[F.when(complete, found[i]).alias(name) for i, name in enumerate(FIELDS)])


def dotted_time(text: Column) -> Column:
    """Log time with "." before the fraction; a valid time has one separator at most."""
    return F.translate(text, ",", ".")


def log_time_nanos(dotted: Column) -> Column:
    """Log time as nanoseconds since the epoch, read as UTC; NULL if malformed."""
    seconds = F.unix_seconds(F.substring_index(dotted, ".", 1).try_cast("timestamp"))
    fraction = F.when(F.contains(dotted, F.lit(".")), F.substring_index(dotted, ".", -1)).otherwise("")
    nanos = F.rpad(F.substring(fraction, 1, 9), 9, "0").cast("bigint")
    return F.when(dotted.rlike(fixed.LOG_TIME), seconds * fixed.NANOS + nanos)


def server_part(url: str) -> str:
    """Scheme and host[:port] of a URL given as option; the path is dropped."""
    for scheme in ("http://", "https://"):
        if url.startswith(scheme):
            return scheme + (urlsplit("//" + url[len(scheme):]).netloc or url[len(scheme):])
    return url.split("/", 1)[0] or url


def request_url(host: Column, index: Column, types: Column, search_type: Column) -> Column:
    """``host/index/types/_search?search_type=...``; empty parts leave empty segments."""
    query = F.when(search_type != "", F.concat(F.lit("?search_type="), F.lower(search_type))).otherwise("")
    return F.concat(F.concat_ws("/", host, index, types, F.lit("_search")), query)
