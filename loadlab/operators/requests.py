"""From slow-log lines to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from loadlab import fixed_values as fixed
from loadlab.functions import bodies, slowlog
from loadlab.operators.sequence import in_order
from loadlab.session import fits_broadcast, stage


def _evaluated(df: DataFrame, struct: Column) -> DataFrame:
    """Add the members of ``struct`` as columns, each computed once per row.

    A plain projection would be merged into every later filter and column that
    uses it, repeating pattern matching and JSON parsing; a generator of one
    row is not.
    """
    return df.select("*", F.inline(F.array(struct)))


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Add the seven slow-log fields, ``ts_nanos``, ``body`` and ``reason``.

    ``reason`` is NULL for a replayable query; otherwise it says why the line
    is not one: ``no match``, ``other log type``, ``bad time`` or ``bad body``.
    Stateless, so it runs on streams as well.
    """
    text = F.col(line)
    marked = _evaluated(lines, slowlog.marks(text))
    found = _evaluated(marked, F.struct(slowlog.groups(text, F.col("types_at"), F.col("search_at")).alias("_found")))
    matched = _evaluated(found, slowlog.fields(F.col("_found")))
    dotted = _evaluated(matched, F.struct(slowlog.dotted_time(F.col("ts")).alias("_dotted")))
    is_query = F.col("log_type") == fixed.QUERY_LOG_TYPE
    time = F.when(is_query, slowlog.log_time_nanos(F.col("_dotted")))
    body = F.when(is_query, bodies.canonical_json(F.col("source")))
    typed = _evaluated(dotted, F.struct(time.alias("ts_nanos"), body.alias("body")))
    typed = typed.drop("types_at", "search_at", "_found", "_dotted")
    reason = (
        F.when(F.col("ts").isNull(), "no match")
        .when(~is_query, "other log type")
        .when(F.col("ts_nanos").isNull(), "bad time")
        .when(F.col("body").isNull(), "bad body")
    )
    return typed.withColumn("reason", reason)


def query_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Only the lines that can be queries, chosen before any pattern is tried."""
    return lines.where(F.contains(F.col(line), F.lit(fixed.QUERY_LOG_TYPE)))


def replayable(lines: DataFrame, line: str = "value") -> DataFrame:
    """Parsed queries; everything else is left to :func:`rejects`."""
    return parse_lines(query_lines(lines, line), line).where(F.col("reason").isNull()).drop("reason")


def rejects(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines that are no valid slow-log entry, with the reason.

    Entries of other log types are valid and simply not replayed.
    """
    wrong = F.col("reason").isNotNull() & (F.col("reason") != "other log type")
    keep = [c for c in lines.columns if c != line]
    return parse_lines(lines, line).where(wrong).select(*keep, line, "reason")


#: Why a line is not replayed, and the name of its count.
REASONS = {"no match": "no_match", "other log type": "other_log_type", "bad time": "bad_time", "bad body": "bad_body"}


def observe(parsed: DataFrame, observed: Observation) -> DataFrame:
    """The parsed lines; ``observed`` gets ``lines``, ``parsed`` and a count per reason from whatever job reads them."""
    counts = [F.count_if(F.col("reason") == reason).alias(name) for reason, name in REASONS.items()]
    return parsed.observe(observed, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reason").isNull()).alias("parsed"), *counts)


def check_share(counts: dict[str, int], max_reject_share: float) -> None:
    """Stop if more than this share of lines is no valid slow-log entry."""
    rejected = counts["lines"] - counts["parsed"] - counts["other_log_type"]
    if rejected > max_reject_share * counts["lines"]:
        raise ValueError(f"{rejected} of {counts['lines']} slow-log lines rejected: {counts}")


def fail_on_reject(parsed: DataFrame, line: str = "value") -> DataFrame:
    """The parsed lines, stopping the job at the first invalid one."""
    message = F.concat(F.lit("slow-log line rejected ("), F.col("reason"), F.lit("): "), F.col(line))
    wrong = F.col("reason").isNotNull() & (F.col("reason") != "other log type")
    checked = F.when(wrong, F.raise_error(message).cast("string")).otherwise(F.col("reason"))
    return parsed.withColumn("reason", checked)


def override_index(
    requests: DataFrame, indexes: list[str], input_order: list[str] = ("ord",), first: int = 0, block: list[str] = ()
) -> DataFrame:
    """The k-th request in input order goes to ``indexes[k % n]``; ``first`` is the k of the first one here.

    With ``block``, the columns that name the part of a file a row was read from, rows stay
    where they are (:func:`numbered_in_place`); otherwise they are sorted.
    """
    if block:
        numbered = numbered_in_place(requests, list(block))
    else:
        numbered = in_order(requests, list(input_order), position="_kept")
    choice = F.element_at(F.array(*[F.lit(i) for i in indexes]), ((F.col("_kept") + first) % len(indexes) + 1).cast("int"))
    return numbered.withColumn("index", choice).drop("_kept")


def numbered_in_place(requests: DataFrame, block: list[str]) -> DataFrame:
    """Staged ``requests`` with ``_kept``, their dense position in input order, without a sort.

    For rows just read from files: the rows of a ``block``, a part of a file, are read by one task and in order, and blocks in
    the order of their columns are the input.  A row's place in its block comes with staging; blocks are counted
    and their offsets, a row per block, are joined to the rows.
    """
    rows = stage(requests.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    blocks = rows.groupBy(*block).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy(*block).rowsBetween(W.unboundedPreceding, -1))
    blocks = stage(blocks.select(*block, "_first", F.coalesce(before, F.lit(0)).alias("_offset")), "blocks")
    texts = [c for c in block if blocks.schema[c].dataType.simpleString() == "string"]
    beside = F.broadcast(blocks) if fits_broadcast(blocks, texts) else blocks
    kept = F.col("_offset") + F.col("_at") - F.col("_first")
    return rows.join(beside, block).withColumn("_kept", kept).drop("_at", "_first", "_offset")


def with_url(requests: DataFrame, server: str | None = None) -> DataFrame:
    """Add the request URL; ``server`` replaces the logged host by its host part."""
    host: Column = F.lit(slowlog.server_part(server)) if server else F.col("host")
    return requests.withColumn(
        "url", slowlog.request_url(host, F.col("index"), F.col("types"), F.col("search_type"))
    )
