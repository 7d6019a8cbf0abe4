"""Global order without a global task: dense positions, lags and running totals.

Two forms, both with per-part totals folded in a table that is small by
construction:

* rows that have to be put in order first (:func:`in_order`) go through one
  range shuffle; the parts are Spark's own range partitions;
* rows that already carry a dense id are cut into id blocks of a fixed size
  (:func:`with_block`), so blocks are even whatever the data looks like; what
  blocks pass on is folded in two levels (:func:`before_block`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadlab.session import stage

BLOCK_ROWS = 100_000
BLOCKS_PER_GROUP = 1_000

_ROW_BITS = (1 << 33) - 1  # row part of monotonically_increasing_id()


def _tag_previous(columns: list[str]):
    """Add run, place in the run, whether the run ends, and the previous row's
    ``columns`` to Arrow batches of one sorted partition.

    A window would need a second shuffle of whole rows to learn what the range
    sort already arranged.
    """

    def tag(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        def ended(batch, is_end):
            ends = np.zeros(batch.num_rows, dtype=bool)
            ends[-1] = is_end
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends)], names=[*batch.schema.names, "_ends"])

        run, place, last, held = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            added = {
                "_run": pa.array(np.full(rows, run, dtype=np.int32)),
                "_place": pa.array(np.arange(place, place + rows, dtype=np.int64)),
            }
            for column in columns:
                values = batch.column(column)
                before = pa.array([last[column] if last else None], values.type)
                added[f"_previous_{column}"] = pa.concat_arrays([before, values.slice(0, rows - 1)])
            last = {column: batch.column(column)[rows - 1].as_py() for column in columns}
            place += rows
            if held is not None:
                yield ended(held, False)
            held = pa.RecordBatch.from_arrays(
                [*batch.columns, *added.values()], names=[*batch.schema.names, *added]
            )
        if held is not None:
            yield ended(held, True)

    return tag


def in_order(df: DataFrame, order: list[str], previous: list[str] = (), position: str = "id") -> DataFrame:
    """Add the dense 0-based ``position`` of each row in the order of ``order``.

    ``order`` must identify a row, so ties have one answer and equal leading
    values (a third of all rows in one millisecond) spread over many tasks.
    For every column in ``previous``, ``previous_<column>`` holds its value in
    the row before (NULL in the first row).

    One shuffle of whole rows; the sorted rows are staged once because range
    bounds are sampled and must not be drawn twice.  Sampling reads ``df`` a
    second time, so hand in something cheap to read.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    if previous:
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        columns = {
            **types,
            "_run": "int",
            "_place": "bigint",
            **{f"_previous_{c}": types[c] for c in previous},
            "_ends": "boolean",
        }
        schema = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
        rows = stage(ranged.mapInArrow(_tag_previous(list(previous)), schema), "ordered")
        # The last row of a run tells its length and what the next run follows.
        runs = rows.where("_ends").select("_run", (F.col("_place") + 1).alias("_rows"), F.struct(*previous).alias("_last"))
    else:
        tagged = ranged.select(
            "*",
            F.spark_partition_id().alias("_run"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_place"),
        )
        rows = stage(tagged, "ordered")
        runs = rows.groupBy("_run").agg(F.count("*").alias("_rows")).withColumn("_last", F.lit(None))

    # One row per range partition: the partition count bounds the broadcast.
    by_run = W.orderBy("_run")
    runs = runs.select(
        "_run",
        (F.sum("_rows").over(by_run) - F.col("_rows")).alias("_offset"),
        F.lag("_last").over(by_run).alias("_carried"),
    )
    numbered = rows.join(F.broadcast(runs), "_run")
    carried = [
        F.when(F.col("_place") == 0, F.col(f"_carried.{c}")).otherwise(F.col(f"_previous_{c}")).alias(f"previous_{c}")
        for c in previous
    ]
    return numbered.select(*df.columns, (F.col("_offset") + F.col("_place")).alias(position), *carried)


def with_block(df: DataFrame, position: str = "id", block_rows: int | None = None) -> DataFrame:
    """Add ``_block``, the id block of a dense 0-based ``position``."""
    return df.withColumn("_block", F.expr(f"`{position}` div {block_rows or BLOCK_ROWS}"))


def before_block(per_block: DataFrame, value: str, out: str, keys: list[str] = (), fold=F.sum) -> DataFrame:
    """``keys, _block, out``: ``fold`` (sum or max) of ``value`` over the blocks before each one.

    Groups of blocks are folded first, so neither level has many rows in a task.
    """
    keys = list(keys)
    grouped = per_block.withColumn("_group", F.expr(f"_block div {BLOCKS_PER_GROUP}"))
    groups = grouped.groupBy(*keys, "_group").agg(fold(value).alias("_all"))
    earlier = W.partitionBy(*keys).orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select(*keys, "_group", fold("_all").over(earlier).alias("_upper"))
    inner = W.partitionBy(*keys, "_group").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    folded = grouped.select(*keys, "_group", "_block", fold(value).over(inner).alias("_lower")).join(groups, [*keys, "_group"])
    if fold is F.max:
        both = F.greatest("_upper", "_lower")
    else:
        both = F.coalesce("_upper", F.lit(0)) + F.coalesce("_lower", F.lit(0))
    return folded.select(*keys, "_block", both.alias(out))


def unfold(df: DataFrame, count: Column, position: str, keys: list[str] = (), block_rows: int | None = None) -> DataFrame:
    """Each row ``count`` times with ``position`` 0 .. ``count`` - 1, made in parallel blocks (``_block``).

    Blocks are shuffled before they are unfolded, so what moves is one row per
    block; the unfolded rows keep the (keys, _block) partitioning and later
    block windows need no shuffle.  No array is longer than a block.
    """
    rows = block_rows or BLOCK_ROWS
    sized = df.withColumn("_count", count.cast("bigint")).where(F.col("_count") > 0)
    groups = sized.withColumn("_group", F.explode(F.expr(f"sequence(0L, (_count - 1) div {rows * BLOCKS_PER_GROUP})")))
    last = F.least(F.expr(f"(_count - 1) div {rows}"), (F.col("_group") + 1) * BLOCKS_PER_GROUP - 1)
    blocks = groups.withColumn("_block", F.explode(F.sequence(F.col("_group") * BLOCKS_PER_GROUP, last)))
    first = F.col("_block") * rows
    return (
        blocks.repartition(*keys, "_block")
        .withColumn(position, F.explode(F.sequence(first, F.least(first + rows, F.col("_count")) - 1)))
        .drop("_count", "_group")
    )


def running_total(
    df: DataFrame, value: str, out: str, position: str = "id", block_rows: int | None = None
) -> DataFrame:
    """Add ``out``, the sum of ``value`` up to and including each row by ``position``.

    ``df`` is read for the block totals and again for the rows; hand in a table
    or staged rows.
    """
    blocked = with_block(df, position, block_rows)
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_total"))
    inside = F.sum(value).over(
        W.partitionBy("_block").orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        blocked.withColumn("_inside", inside)
        .join(before_block(totals, "_total", "_before"), "_block")
        .select(*df.columns, (F.col("_before") + F.col("_inside")).alias(out))
    )


def arrival_delays(df: DataFrame, time: str = "ts_nanos", tie_break: list[str] = ("ord",)) -> DataFrame:
    """Requests in time order with ``id`` and ``delay_since_last_nanos`` (0 in the first row)."""
    ordered = in_order(df, [time, *tie_break], previous=[time])
    delay = F.coalesce(F.col(time) - F.col(f"previous_{time}"), F.lit(0).cast("bigint"))
    return ordered.withColumn("delay_since_last_nanos", delay).drop(f"previous_{time}")


def schedule(loadspec: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Loadspec rows with ``at_nanos``, the time of each request since the start."""
    return running_total(loadspec, "delay_since_last_nanos", "at_nanos", block_rows=block_rows)


def cut_at_duration(df: DataFrame, max_nanos: int, time: str = "ts_nanos") -> DataFrame:
    """Rows up to and including the first one at least ``max_nanos`` after the start.

    Applied before sorting, on the time column alone, so rows that cannot be
    part of the result are never shuffled.  Rows tied with the crossing one are
    left for :func:`cut_ordered`.
    """
    if max_nanos <= 0:
        return df
    start = df.agg(F.min(time)).first()[0]
    if start is None:
        return df
    crossing = df.where(F.col(time) >= start + max_nanos).agg(F.min(time)).first()[0]
    return df if crossing is None else df.where(F.col(time) <= crossing)


def cut_ordered(ordered: DataFrame, max_nanos: int, time: str = "ts_nanos") -> DataFrame:
    """The same cut on rows with ``id`` and delay: exact within ties."""
    if max_nanos <= 0:
        return ordered
    start = ordered.agg(F.min(time)).first()[0]
    if start is None:
        return ordered
    before = F.col(time) - F.col("delay_since_last_nanos")
    return ordered.where((F.col("id") == 0) | (before - F.lit(start) < max_nanos))


def carry_forward(
    df: DataFrame, columns: list[str], position: str, block_rows: int, keys: list[str] = ()
) -> DataFrame:
    """Fill NULLs of ``columns`` with the last value before them, per ``keys``.

    ``position`` is dense per key.  Blocks as in :func:`running_total`: the last
    values of each block travel through a table of one row per key and block.
    """
    keys = list(keys)
    blocked = with_block(df, position, block_rows)
    ends = blocked.groupBy(*keys, "_block").agg(
        *[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(position))).alias(f"_last_{c}") for c in columns]
    )
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_block", *[F.last(F.col(f"`_last_{c}`"), ignorenulls=True).over(earlier).alias(f"_carried_{c}") for c in columns]
    )
    inside = W.partitionBy(*keys, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = {
        c: F.coalesce(F.last(F.col(f"`{c}`"), ignorenulls=True).over(inside), F.col(f"`_carried_{c}`")) for c in columns
    }
    return (
        blocked.join(carried, [*keys, "_block"])
        .select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
    )
