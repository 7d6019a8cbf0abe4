"""Which requests are dropped while a server has asked for a pause.

A pause accepted at request ``p`` drops the requests after it whose predecessor
was due within the pause.  A pause asked for by a dropped request does not
count, so which pauses count is a chain: from an accepted pause to the first
pause request it does not cover.  The chain is found without walking the log:
every pause request gets a pointer to its successor, pointers are followed inside
id blocks of a fixed size, and between blocks by doubling, in as many
joins as the block count has bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from loadlab.operators.sequence import BLOCK_ROWS, before_block, carry_forward, in_order, with_block
from loadlab.session import stage


def _pointers(pauses: DataFrame, block_rows: int) -> DataFrame:
    """``place, next``: the first pause request not covered by each pause.

    Pause requests and pause ends are put in descending order of time together;
    the last pause request passed before an end is its successor.  Both kinds
    spread over the range partitions however many ends coincide.
    """
    requests = pauses.select((-F.col("previous_at")).alias("_t"), F.lit(0).alias("_kind"), (-F.col("place")).alias("_p"))
    ends = pauses.select((-F.col("end")).alias("_t"), F.lit(1).alias("_kind"), (-F.col("place")).alias("_p"))
    mixed = in_order(requests.unionByName(ends), ["_t", "_kind", "_p"], position="_n")
    passed = mixed.withColumn("next", F.when(F.col("_kind") == 0, -F.col("_p")))
    filled = carry_forward(passed, ["next"], "_n", block_rows)
    return filled.where(F.col("_kind") == 1).select((-F.col("_p")).alias("place"), "next")


def _inside(places: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Follow pointers while they stay in the block; the first pointer out of it (-1: none)."""
    first, count = places[0], len(places)
    out = following.copy()
    while True:
        inner = (out >= 0) & (out < first + count)
        if not inner.any():
            return out
        out[inner] = out[out[inner] - first]


def _leave_block(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("place")
    places = block["place"].to_numpy()
    following = block["next"].fillna(-1).astype("int64").to_numpy()
    return pd.DataFrame({"place": places, "leaves_to": _inside(places, following)})


def _walk_block(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("place")
    first, count = int(block["place"].iloc[0]), len(block)
    following = block["next"].fillna(-1).astype("int64").to_numpy()
    at, visited = int(block["entry"].iloc[0]), []
    while first <= at < first + count:
        visited.append(at)
        at = int(following[at - first])
    return pd.DataFrame({"place": np.array(visited, dtype="int64")})


def _root(df: DataFrame) -> DataFrame:
    """The first pause request always counts."""
    return df.sparkSession.range(1).select(F.col("id").alias("place"))


def _reached(exits: DataFrame) -> DataFrame:
    """Block entries on the way from pause request 0: at most one per block."""
    entries = exits.where("leaves_to >= 0").select(F.col("leaves_to").alias("place")).distinct()
    root = _root(exits)
    jump = exits.join(entries.unionByName(root).distinct(), "place", "left_semi")
    jump = stage(jump.where("leaves_to >= 0"), "pause-jumps")
    reached = root
    while not jump.isEmpty():
        step = reached.join(jump, "place").select(F.col("leaves_to").alias("place"))
        reached = stage(reached.unionByName(step).distinct(), "pause-entries")
        further = jump.select(F.col("place").alias("leaves_to"), F.col("leaves_to").alias("_next"))
        jump = stage(
            jump.join(further, "leaves_to").select("place", F.col("_next").alias("leaves_to")), "pause-jumps"
        )
    return reached


def accepted_pauses(schedule: DataFrame, pauses: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``id, end``: the pauses that count, with their end on the schedule.

    ``schedule`` has ``id, delay_since_last_nanos, at_nanos``; ``pauses`` has
    ``id, pause_nanos``, one row per request that was told to wait.
    """
    due = schedule.select("id", "at_nanos", (F.col("at_nanos") - F.col("delay_since_last_nanos")).alias("previous_at"))
    asked = pauses.where("pause_nanos > 0").join(due, "id").select(
        "id", "previous_at", (F.col("at_nanos") + F.col("pause_nanos")).alias("end")
    )
    asked = in_order(asked, ["id"], position="place")
    count = asked.count()
    size = block_rows or BLOCK_ROWS
    pointers = with_block(stage(_pointers(asked, size), "pause-pointers"), "place", size)
    if count > size:
        exits = pointers.groupBy("_block").applyInPandas(_leave_block, "place BIGINT, leaves_to BIGINT")
        reached = _reached(stage(exits, "pause-exits"))
    else:
        reached = _root(asked)
    # At most one entry per block.
    entries = with_block(reached, "place", size).select("_block", F.col("place").alias("entry"))
    walked = (
        pointers.join(entries, "_block").groupBy("_block").applyInPandas(_walk_block, "place BIGINT")
    )
    return asked.join(walked, "place").select("id", "end")


def mark_dropped(schedule: DataFrame, pauses: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The schedule with ``dropped``: whether the request falls into an accepted pause.

    Accepted pauses do not overlap, so the largest end seen so far is that of
    the last one, and a running maximum replaces the range join.
    """
    accepted = accepted_pauses(schedule, pauses, block_rows)
    marked = schedule.join(accepted, "id", "left")
    blocked = stage(with_block(marked, "id", block_rows), "paused")
    ends = blocked.groupBy("_block").agg(F.max("end").alias("_end"))
    earlier = before_block(ends, "_end", "_carried", fold=F.max)
    before = W.partitionBy("_block").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    covered = F.greatest(F.max("end").over(before), F.col("_carried"))
    previous_at = F.col("at_nanos") - F.col("delay_since_last_nanos")
    return blocked.join(earlier, "_block").select(
        *schedule.columns, F.coalesce(previous_at < covered, F.lit(False)).alias("dropped")
    )


def kept(schedule: DataFrame, pauses: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The requests that are sent."""
    return mark_dropped(schedule, pauses, block_rows).where(~F.col("dropped")).drop("dropped")
