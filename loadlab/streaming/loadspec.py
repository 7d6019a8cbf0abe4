"""A loadspec out of a slow log that keeps growing.

Every micro-batch of lines is parsed and put in order as the batch job does it; ids and delays go on where the
batch before ended.  What a batch hands on, the number of requests so far and the first and last time, is a
row written with the batch, so a batch that runs twice gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loadlab import fixed_values as fixed
from loadlab.operators import requests, sequence
from loadlab.plans.loadspecs import COLUMNS
from loadlab.session import prepare, stage
from loadlab.streaming.batches import read_all, write_batch

CARRY = "requests bigint, start_nanos bigint, last_nanos bigint, late bigint"


def _carried(spark: SparkSession, folder: str, batch_id: int):
    """What the batch before hands on: one row."""
    if batch_id == 0:
        return None
    return spark.read.schema(CARRY).parquet(f"{folder}/carry/batch={batch_id - 1}").first()


def sequence_batch(
    lines: DataFrame, batch_id: int, folder: str, order: list[str], server: str | None, indexes: list[str], max_nanos: int
) -> None:
    """Write a batch's part of the loadspec, its late requests and what it hands on."""
    spark = lines.sparkSession
    before = _carried(spark, folder, batch_id)
    made, start, last, late = before or (0, None, None, 0)
    columns = [*order, "ts_nanos", "host", "index", "types", "search_type", "body"]
    rows = stage(requests.replayable(lines).select(*columns), "requests")
    behind = F.lit(False) if last is None else F.col("ts_nanos") < last
    timely = rows.where(~behind)
    if indexes:
        timely = requests.override_index(timely, indexes, order, first=made)
    wide = requests.with_url(timely, server).select(*order, "ts_nanos", "url", F.col("body").alias("source"))
    # Numbered and staged once; the part's own ids start at 0.
    ordered = sequence.in_order(wide, ["ts_nanos", *order], previous=["ts_nanos"])
    facts = ordered.agg(F.count("*").alias("n"), F.min("ts_nanos").alias("low"), F.max("ts_nanos").alias("high")).first()
    start = facts.low if start is None else start
    since = F.coalesce("previous_ts_nanos", F.lit(last).cast("bigint"), F.col("ts_nanos"))
    spec = ordered.select(
        (F.col("id") + made).alias("id"), (F.col("ts_nanos") - since).alias("delay_since_last_nanos"), "url", "source", "ts_nanos"
    )
    if max_nanos > 0 and start is not None:
        spec = spec.where((F.col("id") == 0) | (F.col("ts_nanos") - F.col("delay_since_last_nanos") - start < max_nanos))
    write_batch(spec.select(*COLUMNS), f"{folder}/loadspec", batch_id)
    dropped = rows.where(behind)
    write_batch(dropped, f"{folder}/late", batch_id)
    row = (made + facts.n, start, last if facts.high is None else facts.high, late + (dropped.count() if last is not None else 0))
    write_batch(spark.createDataFrame([row], CARRY), f"{folder}/carry", batch_id)


def stream_loadspec(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    order: list[str],
    server: str | None = None,
    indexes: list[str] = (),
    max_duration_seconds: float = 0,
    **trigger,
) -> StreamingQuery:
    """Write the loadspec of the lines that arrive below ``folder``; read it with :func:`read_loadspec`.

    ``order`` identifies a line in a batch and breaks ties in time.  ``indexes`` go round over the requests of all
    batches in the order of ``order``, ``max_duration_seconds`` counts from the first request of all.  Requests from before
    the last time of an earlier batch can't get a place any more: they are kept in ``late`` and counted.
    """
    prepare(stream.sparkSession)
    max_nanos = int(max_duration_seconds * fixed.NANOS)

    def process(lines: DataFrame, batch_id: int) -> None:
        # The arrived lines themselves, so that parsing twice is reading twice the same.
        sequence_batch(stage(lines, "arrived"), batch_id, folder, list(order), server, list(indexes), max_nanos)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_loadspec(spark: SparkSession, folder: str) -> DataFrame:
    """The loadspec as far as it has come."""
    return read_all(spark, f"{folder}/loadspec")


def late_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that came after the loadspec had passed their time."""
    return read_all(spark, f"{folder}/late")
