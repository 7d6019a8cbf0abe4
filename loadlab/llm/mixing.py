"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, offered ``repeats``
times.  A document that ends after ``c`` words of its queue has the virtual
finish time ``c / target``: all queues are then served at rates proportional to
their targets, and at virtual time 1 each has sent exactly its target.  The mix
is the global order by finish time, cut at the total budget; the document in
service at the cut is cut at a word.

DataFrame operations only.  Prefix sums go over two levels of blocks: words
inside a block by a window per block, block totals by a window over blocks.
Blocks are ranges of the shuffle hash or of virtual time, about the square root of the rows
in number, so a source with a third of all rows is as even as any other.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadlab.session import stage

WEIGHTS = (3, 1, 2)
#: All targets together are 3 / 2 of all words.
BUDGET = (3, 2)
REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, budget: tuple[int, int] = BUDGET, repeats: int = REPEATS
) -> DataFrame:
    """``source, source_size, target`` from rows ``(source, size)``.

    Sources in code point order, NULL last, weigh ``weights`` in turn.  A target
    stops at ``repeats`` times its source's size; what is above is shared among
    the others by weight until none is above.  Sorted by how early they are
    full, the full ones are a prefix, so one window finds them; integers until the last division.
    One row per source passes through one task.
    """
    num, den = budget
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("_w"))
    everything = W.partitionBy()
    filling = W.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    per = per.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        (F.sum("source_size").over(filling.rowsBetween(W.unboundedPreceding, 0)) - F.col("source_size")).alias("_before"),
        F.sum("_w").over(filling.rowsBetween(0, W.unboundedFollowing)).alias("_open"),
    )
    full = F.col("source_size") * (repeats * den) * F.col("_open") <= F.col("_w") * (
        F.col("_all") * num - F.col("_before") * (repeats * den)
    )
    per = per.withColumn("_full", full)
    held = F.sum(F.when(F.col("_full"), F.col("source_size")).otherwise(0)).over(everything)
    open_ = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(everything)
    share = (F.col("_w") * (F.col("_all") * num - held * (repeats * den))).cast("double") / (open_ * den)
    capped = (F.col("source_size") * repeats).cast("double")
    return per.select("source", "source_size", F.when(F.col("_full"), capped).otherwise(share).alias("target"))


def _before(rows: DataFrame, value: str, groups: list[str], block: str, order: list, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group before each row."""
    totals = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in [*groups, block]]).agg(F.sum(value).alias("_t"))
    earlier = W.partitionBy(*[f"_of_{g}" for g in groups]).orderBy(f"_of_{block}")
    totals = totals.withColumn("_earlier", F.sum("_t").over(earlier) - F.col("_t"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*groups, block]])
    inside = W.partitionBy(*groups, block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum(value).over(inside) - F.col(value))
    joined = summed.join(totals, same, "left")
    return joined.select(*rows.columns, (F.col("_inside") + F.col("_earlier")).alias(out))


def mix(
    documents: DataFrame,
    weights: tuple = WEIGHTS,
    budget: tuple[int, int] = BUDGET,
    repeats: int = REPEATS,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep_rest: bool = False,
) -> DataFrame:
    """The mix, a row per document and repeat that it takes.

    ``row`` (a number per input row), ``doc_id``, ``source``, ``size``,
    ``source_size``, ``target``, ``repeat`` from 0, ``words`` taken (from the
    start of the text) and ``position``, the words of the mix before it.  With
    ``keep_rest`` also rows that take no word, without position.

    NULL texts and texts without words have size 0 and are never taken; NULL is a
    source of its own; rows with the same key are separate documents; an
    empty table gives an empty mix; columns other than the three named are not read.
    """
    read = documents.select(
        F.monotonically_increasing_id().alias("row"),
        documents[key].alias("doc_id"),
        documents[source].cast("string").alias("source"),
        word_count(documents[text]).alias("size"),
    ).withColumn("shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = stage(read, "mix-sizes")
    blocks = max(1, round(sized.count() ** 0.5))
    targets = source_targets(sized, weights, budget, repeats)
    fair = targets.select(F.col("source").alias("_s"), "source_size", "target")
    ranged = sized.withColumn("_block", F.expr(f"cast(conv(substr(shuffle, 1, 8), 16, 10) as bigint) * {blocks} div 4294967296"))
    queued = _before(ranged, "size", ["source"], "_block", ["shuffle", "size"], "_start")
    # One row per source; AQE takes care of a hot one should Spark not broadcast it.
    queued = queued.join(fair, F.col("source").eqNullSafe(F.col("_s")))

    offered = queued.withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    start = F.col("_start") + F.col("repeat") * F.col("source_size")
    left = F.floor("target").cast("bigint") - start
    words = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), left))
    offered = offered.select(
        "row", "doc_id", "source", "shuffle", "size", "source_size", "target", "repeat", words.alias("words"),
        ((start + words).cast("double") / F.col("target")).alias("_finish"),
    )
    taken = offered.where("words > 0")
    timed = taken.withColumn("_span", F.least(F.floor(F.col("_finish") * blocks), F.lit(blocks - 1)))
    order = ["_finish", F.col("source").asc_nulls_last(), "repeat", "shuffle", "size"]
    columns = ["row", "doc_id", "source", "size", "source_size", "target", "repeat", "words", "position"]
    placed = _before(timed, "words", [], "_span", order, "position").select(*columns)
    if not keep_rest:
        return placed
    rest = offered.where("words = 0").withColumn("position", F.lit(None).cast("bigint"))
    return placed.unionByName(rest.select(*columns))


def shares(documents: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, position`` for each document:
    the words that :func:`mix` takes of it, repeats counted, and where it first stands."""
    takes = mix(documents, keep_rest=True, **options)
    return takes.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
        F.sum("words").alias("taken"),
        F.min("position").alias("position"),
    ).drop("row")
