"""Requests against the loadspec they were sent from, while the test runs.

Entries that have been sent and responses come as two streams, in any order within the watermark.  An entry is joined
with its response when both are there; once the watermark has passed the time in which a response may come,
an entry without one leaves as unsent, and the state of both sides goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DEFAULT_WATERMARK = "10 seconds"


def attributed(
    sent: DataFrame,
    responses: DataFrame,
    answer_seconds: int,
    watermark: str = DEFAULT_WATERMARK,
    sent_time: str = "sent_time",
    time: str = "time",
) -> DataFrame:
    """Every entry of ``sent`` (``id``, ``sent_time``) with the columns of its response, NULL without one.

    ``responses`` has ``id`` and ``time``; one that comes more than ``answer_seconds`` after its entry was sent, or
    before it, is none.  Entries without an ``id`` or a time, and rows behind the watermark, are dropped.  An entry with several responses
    leaves several times.
    """
    left = sent.where(F.col("id").isNotNull()).withWatermark(sent_time, watermark).alias("sent")
    right = responses.withColumnRenamed("id", "_id").withWatermark(time, watermark).alias("response")
    in_time = F.expr(
        f"sent.id = response._id AND response.`{time}` >= sent.`{sent_time}` "
        f"AND response.`{time}` <= sent.`{sent_time}` + INTERVAL {int(answer_seconds)} SECONDS"
    )
    return left.join(right, in_time, "leftOuter").drop("_id")


def unsent(joined: DataFrame, time: str = "time") -> DataFrame:
    """Entries of :func:`attributed` that no response came for."""
    return joined.where(F.col(time).isNull()).drop(time)


def answered(joined: DataFrame, time: str = "time") -> DataFrame:
    return joined.where(F.col(time).isNotNull())
