"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at minimiser positions: in every run of ``least``
words the ``GRAM``-word sequence with the smallest hash, so any passage of
``least`` words keeps the same suffix wherever it stands.  Suffixes whose first
words occur once are dropped; the others get the words around them and are sorted over all documents, by
the words that follow and once more by the words before.  Each is compared with
its neighbour: their common words are counted to the right and to the left, and ``least`` or more are a repeated passage.

A context of ``least`` words on both sides is enough: a longer passage has more
suffixes, and what they find is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from loadlab.llm.membership import filter_bits, in_filter, place_of
from loadlab.llm.words import lowered, shingles, slices, split_words
from loadlab.session import stage

LEAST = 50
GRAM = 10
_AT = np.uint64((1 << 24) - 1)


def minimisers(gram: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Positions of the leftmost smallest ``gram`` (its upper 40 bits) of every ``window`` of one row."""
    picked = []
    for base in range(0, len(gram), 1 << 23):  # places fit their 24 bits
        own, rows = gram[base : base + (1 << 23) + window], row[base : base + (1 << 23) + window]
        n = len(own) - window + 1
        if n <= 0:
            continue
        least = (own & ~_AT) | np.arange(len(own), dtype=np.uint64)
        size = 1
        while size * 2 <= window:
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[window - size : window - size + n])
        least = least[rows[:n] == rows[window - 1 :]]
        picked.append((least & _AT).astype(np.int64) + base)
    # From one window to the next the leftmost smallest value never moves back.
    at = np.concatenate(picked) if picked else np.zeros(0, dtype=np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))[: len(at)]]


def _words(column: pa.Array):
    return split_words(lowered(column), signs=True)


def _suffixes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words = _words(part.column("text"))
                gram, row = shingles(words.hash, words.first, GRAM, whole_if_short=False)
                at = minimisers(gram, row, least - GRAM + 1)
                begin = np.searchsorted(row, np.arange(part.num_rows))
                rows = row[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[at].view(np.int64)), part.column("k").take(pa.array(rows)), pa.array((at - begin[rows]).astype(np.int32))],
                    names=["gram", "k", "pos"],
                )

    return run


def _contexts(least: int):
    """Suffixes with the hashes of ``least`` words from theirs on and of ``least - 1`` before, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words = _words(part.column("text"))
                # 0 stands for what is beyond a text; no two such places count as common.
                short = np.append((words.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                positions = part.column("positions")
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(positions.offsets)))
                pos = positions.flatten().to_numpy()
                at, stop = words.first[row] + pos, words.first[row + 1]
                for i in range(0, len(at), 4_000):
                    a, e, f = at[i : i + 4_000, None], stop[i : i + 4_000, None], words.first[row[i : i + 4_000], None]
                    right = a + np.arange(least)
                    left = a - 1 - np.arange(least - 1)
                    right = short[np.where(right < e, right, len(short) - 1)].astype(">u4")
                    left = short[np.where(left >= f, left, len(short) - 1)].astype(">u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r.tobytes() for r in right], pa.binary()),
                            pa.array([x.tobytes() for x in left], pa.binary()),
                            part.column("k").take(pa.array(row[i : i + 4_000])),
                            pa.array(pos[i : i + 4_000]),
                        ],
                        names=["right", "left", "k", "pos"],
                    )

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").reshape(len(column), width)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words at the start of each row, up to a text's end."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class _Run:
    """Neighbours that share a passage, in sorted order."""

    def __init__(self):
        self.k: list[int] = []
        self.pos: list[int] = []
        self.start: list[int] = []
        self.stop: list[int] = []

    def table(self) -> list:
        first = min(range(len(self.k)), key=lambda i: (self.k[i], self.pos[i])) if self.k else 0
        return [(k, a, b, i != first) for i, (k, a, b) in enumerate(zip(self.k, self.start, self.stop))]


_FOUND = "k bigint, start int, stop int, earlier boolean, edge int, right binary, left binary, pos int"


def _found(rows: list, edges: list = ()) -> pa.RecordBatch:
    n, m = len(rows), len(edges)
    none = [None] * n
    column = lambda i, kind: pa.array([r[i] for r in rows] + [None] * m, kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows] + [e[3] for e in edges], pa.int64()),
            column(1, pa.int32()), column(2, pa.int32()), column(3, pa.bool_()),
            pa.array(none + [e[0] for e in edges], pa.int32()),
            pa.array(none + [e[1] for e in edges], pa.binary()),
            pa.array(none + [e[2] for e in edges], pa.binary()),
            pa.array(none + [e[4] for e in edges], pa.int32()),
        ],
        names=["k", "start", "stop", "earlier", "edge", "right", "left", "pos"],
    )


def _neighbours(least: int, between: bool = False):
    """Compare every row of a sorted partition with the next.

    The first and the last row are handed on as edges ``2 * partition`` and
    ``2 * partition + 1``.  ``between``: the rows are such edges, and only a
    last row is compared with the first one after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        held, first, current = None, None, _Run()
        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first = batch.slice(0, 1)
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            right, left = _matrix(table["right"], least), _matrix(table["left"], least - 1)
            r, l = common(right[:-1], right[1:]), common(left[:-1], left[1:])
            shared = r + l >= least
            if between:
                edge = table["edge"].to_numpy()
                shared &= (edge[:-1] % 2 == 1) & (edge[1:] % 2 == 0)
            k, pos = table["k"].to_numpy(), table["pos"].to_numpy()
            out = []
            for i in np.flatnonzero(shared).tolist():
                if not current.k or (current.k[-1], current.pos[-1]) != (k[i], pos[i]):
                    out += current.table()
                    current = _Run()
                    for x, v in ((current.k, k[i]), (current.pos, pos[i]), (current.start, pos[i] - l[i]), (current.stop, pos[i] + r[i])):
                        x.append(int(v))
                else:
                    current.start[-1] = min(current.start[-1], int(pos[i] - l[i]))
                    current.stop[-1] = max(current.stop[-1], int(pos[i] + r[i]))
                j = i + 1
                for x, v in ((current.k, k[j]), (current.pos, pos[j]), (current.start, pos[j] - l[i]), (current.stop, pos[j] + r[i])):
                    x.append(int(v))
            if out:
                yield _found(out)
            held = table.slice(table.num_rows - 1).to_batches()[0]
        edges = []
        if first is not None and not between:
            for side, row in enumerate((first, held)):
                edges.append((2 * partition + side, *[row.column(c)[0].as_py() for c in ("right", "left", "k", "pos")]))
        yield _found(current.table(), edges)

    return run


def _compared(contexts: DataFrame, by: list[str], least: int) -> DataFrame:
    """``k, start, stop, earlier`` of what neighbours in the order of ``by`` share."""
    order = [*by, "k", "pos"]
    ranged = contexts.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(ranged.mapInArrow(_neighbours(least), _FOUND), "neighbours")
    edges = found.where("edge is not null").select("right", "left", "k", "pos", "edge")
    # Two rows for each partition at most.
    meeting = edges.repartition(1).sortWithinPartitions("edge").mapInArrow(_neighbours(least, between=True), _FOUND)
    return found.unionByName(meeting).where("edge is null").select("k", "start", "stop", "earlier")


def repeated_passages(documents: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start_word, end_word, n_words, earlier``: the passages of each document that stand elsewhere too.

    Words are lower-cased runs without blanks and ASCII signs, numbered from 0; ``end_word`` is
    exclusive.  A passage is covered word by word by sequences of at least ``least`` words
    that occur elsewhere, in another document or the same one.  ``earlier`` says that
    one of the others stands before it, in a smaller key or further left: leave those out and
    one copy stays.  NULL, empty and shorter texts have none; rows with a NULL key are
    not searched; repeated rows repeat each other.  ``key`` is an integer.
    """
    # Texts go to Python in small batches: with long ones, a batch by rows alone takes much memory.
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    source = documents.select(documents[key].cast("bigint").alias("k"), documents[text].alias("text")).where("k is not null")
    sparse = stage(source.mapInArrow(_suffixes(least), "gram bigint, k bigint, pos int"), "suffixes")
    # As a table of its own, so that adaptive execution can split a very common sequence in the join.
    again = stage(sparse.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeated-grams")
    left = sparse.join(again, "gram").groupBy("k").agg(F.collect_set("pos").alias("positions"))
    left = stage(left, "repeated-suffixes")

    bits = filter_bits(left, place_of("k"))
    near = source.select("k", place_of("k").alias("place"), "text").mapInArrow(in_filter(bits, ["k", "text"]), "k bigint, text string")
    contexts = left.join(near, "k").mapInArrow(_contexts(least), "right binary, left binary, k bigint, pos int")
    contexts = stage(contexts, "contexts")
    # By what follows, then by what goes before: who shares a passage is next to it in one of the orders.
    rows = _compared(contexts, ["right", "left"], least).unionByName(_compared(contexts, ["left", "right"], least))

    before = W.partitionBy("k").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("k").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, 0)
    opened = rows.withColumn("_new", F.when(F.col("start") <= F.max("stop").over(before), 0).otherwise(1))
    numbered = opened.withColumn("_passage", F.sum("_new").over(so_far))
    merged = numbered.groupBy("k", "_passage").agg(
        F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.max("earlier").alias("earlier")
    )
    return merged.select(
        F.col("k").alias(key), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "earlier"
    )
