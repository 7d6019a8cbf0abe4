"""Time since the previous request of the same key, across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from loadlab.operators.sequence import in_order
from loadlab.session import stage
from loadlab.streaming.batches import fold, read_before, write_batch


def batch_delays(rows: DataFrame, key: str, time: str, tie_break: list[str], last_seen: DataFrame | None) -> DataFrame:
    """``rows`` with ``delay`` and ``late``.

    ``delay`` counts from the row before with the same key, for the first one
    from ``last_seen`` (``key, last``), else it is 0.  A row older than the last
    one of an earlier batch is ``late`` and has delay 0.

    Rows are put in order by (key, time), so a key with a third of the rows is
    shared by many tasks; only the first row of each key meets the state.
    """
    ordered = in_order(rows, [key, time, *tie_break], previous=[key, time], position="_n")
    same = F.col(f"previous_{key}").eqNullSafe(F.col(key))
    later = ordered.where(same).withColumn("_since", F.col(f"previous_{time}"))
    first = ordered.where(~same)
    if last_seen is None:
        first = first.withColumn("_since", F.lit(None).cast("bigint"))
    else:
        first = first.join(last_seen.withColumnRenamed("last", "_since"), key, "left")
    since = F.coalesce("_since", F.col(time))
    return later.unionByName(first).select(
        *rows.columns,
        F.greatest(F.col(time) - since, F.lit(0)).alias("delay"),
        (F.col(time) < since).alias("late"),
    )


def stream_delays(
    stream: DataFrame, key: str, time: str, tie_break: list[str], out: str, state: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write rows with their delay to ``out``; the last time per key goes to ``state``.

    A batch writes the keys it has seen; now and then all keys are folded into one table.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"`{key}` {kinds[key]}, last {kinds[time]}"

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max("last").alias("last"))

    def process(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        arrived = stage(rows, "arrived")
        known = latest(read_before(spark, state, batch_id, schema)) if batch_id else None
        write_batch(batch_delays(arrived, key, time, tie_break, known), out, batch_id)
        write_batch(latest(arrived.select(key, F.col(time).alias("last"))), state, batch_id)
        fold(spark, state, batch_id, schema, latest)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
