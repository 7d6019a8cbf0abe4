"""Time since the previous request of the same key, for rows that arrive out of order.

Rows wait in keyed state until the watermark has passed them, then leave in the order of time.
State lives in the state store: a batch costs what its keys hold, whatever other keys there are.
A key is one task's; where one key has a large share of all rows and rows come in
order, :mod:`loadlab.streaming.delays` deals a key to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER_OPTION = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Per key: rows the watermark has not passed, and the time of the last one that left.

    ``columns`` are those of a row, ``place`` the columns to sort by, the time in microseconds first.
    One timer per key stands at its earliest waiting row; without waiting rows it
    stands where an idle key is forgotten.
    """

    def __init__(self, columns: list[str], schema: str, place: list[str], forget_micros: int | None):
        self.columns, self.schema, self.forget_micros = columns, schema, forget_micros
        self.at = [columns.index(c) for c in place]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.last = handle.getValueState("last", "micros long")
        self.timer = handle.getValueState("timer", "millis long")

    def _set_timer(self, millis: int | None) -> None:
        before = self.timer.get()[0] if self.timer.exists() else None
        if before == millis:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if millis is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(millis)
            self.timer.update((millis,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            if not len(part):
                continue
            values = part[self.columns].astype(object)
            self.waiting.appendList([tuple(r) for r in values.where(values.notna(), None).itertuples(index=False)])
            first = int(part[self.columns[self.at[0]]].min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            due = earliest // 1000 + 1
            # The timer of an idle key, or of a later row, moves to the new row.
            standing = self.timer.get()[0] if self.timer.exists() and self.last_waits() else None
            self._set_timer(due if standing is None else min(due, standing))
        return iter(())

    def last_waits(self) -> bool:
        """Whether the timer stands for a waiting row and not for the end of an idle key."""
        if self.forget_micros is None or not self.last.exists():
            return True
        return self.timer.get()[0] != self._end(self.last.get()[0])

    def _end(self, last: int) -> int:
        """When a key whose last row left at ``last`` is forgotten: no later row is near enough to count from it."""
        return (last + self.forget_micros) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        # NULLs of a tie break come first, as they sort in Spark.
        rows.sort(key=lambda r: [(r[i] is not None, r[i] if r[i] is not None else 0) for i in self.at])
        ready = [r for r in rows if r[self.at[0]] < passed]
        rest = rows[len(ready) :]
        last = self.last.get()[0] if self.last.exists() else None
        delays = []
        for row in ready:
            time = row[self.at[0]]
            first = last is None or (self.forget_micros is not None and time - last > self.forget_micros)
            delays.append(0 if first else time - last)
            last = time
        if ready:
            self.last.update((last,))
        if rest:
            self.waiting.put(rest)
        elif rows:
            self.waiting.clear()
        # The timer that fired is gone; what stands is set anew.
        self.timer.clear()
        if rest:
            self._set_timer(rest[0][self.at[0]] // 1000 + 1)
        elif last is not None and self.forget_micros is not None:
            end = self._end(last)
            if end * 1000 <= passed:
                self.last.clear()
            else:
                self._set_timer(end)
        if ready:
            out = pd.DataFrame([list(r) for r in ready], columns=self.columns)
            out["delay"] = delays
            yield out

    def close(self) -> None:
        pass


def stream_delays_unordered(
    stream: DataFrame,
    key: str,
    time: str,
    tie_break: list[str],
    out: str,
    checkpoint: str,
    watermark: str = "10 minutes",
    forget_after_seconds: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Write rows with ``delay``, microseconds since the row before with the same key (0 for the first), to ``out``.

    ``time`` is in microseconds.  A row leaves when the watermark, ``watermark`` behind the latest
    time seen, has passed it; until then rows that come late find their place.  Later ones,
    and rows without a time, are dropped.  ``tie_break`` orders rows of the same
    time.  A NULL key is a key.  With ``forget_after_seconds`` a row that
    comes so long after the one before is a first one, and the state of idle keys goes.
    """
    spark = stream.sparkSession
    columns = stream.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    timed = stream.where(F.col(time).isNotNull()).withColumn("_event_time", F.timestamp_micros(F.col(time)))
    # A key of its own name, so that rows keep all their columns.
    keyed = timed.withWatermark("_event_time", watermark).withColumn("_key", F.col(key)).groupBy("_key")
    forget = None if forget_after_seconds is None else forget_after_seconds * 1_000_000
    processor = InOrder(columns, schema, [time, *tie_break], forget)
    delayed = keyed.transformWithStateInPandas(processor, f"{schema}, delay bigint", "Append", "EventTime")
    writer = delayed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append").trigger(**(trigger or {"availableNow": True}))
    before = spark.conf.get(PROVIDER_OPTION)
    # Several kinds of state per key need this store; the query keeps the setting it starts with.
    spark.conf.set(PROVIDER_OPTION, PROVIDER)
    try:
        return writer.start()
    finally:
        spark.conf.set(PROVIDER_OPTION, before)
