"""Token ids of documents, packed into rows of equal length.

Texts are encoded with a public byte-level vocabulary and end with the
end-of-text id.  Within a task, documents are gathered to blocks of about
``block_tokens`` and each block is packed best-fit decreasing: the longest
segment goes first, into the open row with the least room that still takes it,
which a segment tree over free capacities finds in log(length) steps.  A
document longer than a row is split, nothing is cut off.

No shuffle: tokens are written where the text was read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loadlab.llm.words import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of blanks this long are encoded by themselves: the splitting pattern tries every end of a run.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
END_OF_TEXT = 50256
LENGTH = 4096
BLOCK_TOKENS = 1 << 21


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes, split: str = SPLIT):
    """The encoder of a rank file's content."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packing", pat_str=split, mergeable_ranks=ranks, special_tokens={})


def encode(encoder, text: str) -> np.ndarray:
    """The ids of a text, those of the encoder itself, however long a run of blanks is.

    Of a run, all but the last character are one piece where something else follows, and the last one belongs to that.
    """
    found, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        found += [encoder.encode_to_numpy(text[at : run.start()], disallowed_special=()), encoder._encode_single_piece(text[run.start() : end])]
        at = end
    rest = encoder.encode_to_numpy(text[at:], disallowed_special=())
    return np.concatenate([*found, rest]) if found else rest


class Capacities:
    """Open rows by free capacity 0 .. ``most``, in a segment tree of counts."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, free: int, change: int) -> None:
        at = free + self.size
        while at:
            self.count[at] += change
            at >>= 1

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least free capacity of at least ``need``, taken out, and that capacity."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                at += not self.count[at]
        free = at - self.size
        self._add(free, -1)
        return self.rows[free].pop(), free


def best_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """The row of each segment (``1 <= length <= most``) and the number of rows.

    Equal lengths go in input order, so the result is the same in every run."""
    where, open_, rows = np.empty(len(lengths), dtype=np.int64), Capacities(most), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_.take(need)
        if found is None:
            found, rows = (rows, most), rows + 1
        where[i] = found[0]
        if found[1] > need:
            open_.put(found[0], found[1] - need)
    return where, rows


def _pack(keys: pa.Array, tokens: list[np.ndarray], length: int, end: int, kind: type, first_id: int) -> dict[str, pa.Array]:
    sizes = np.array([len(t) for t in tokens])
    pieces = -(-sizes // length)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    offset = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
    lengths = np.minimum(length, sizes[owner] - offset)
    where, rows = best_fit_decreasing(lengths, length)
    order = np.lexsort((-lengths, where))
    matrix = np.full((rows, length), end, dtype=kind)
    per_row = np.bincount(where, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
    inside = np.cumsum(lengths[order]) - lengths[order]
    start = (inside - np.repeat(inside[begin[:-1]], per_row)).astype(np.int32)
    for s, at in zip(order, start):
        matrix[where[s], at : at + lengths[s]] = tokens[owner[s]][offset[s] : offset[s] + lengths[s]]
    used = np.bincount(where, weights=lengths, minlength=rows).astype(np.int32)
    bounds = np.insert(np.append(start, 0)[:-1], begin[1:], used)
    lists = lambda values, b=begin: pa.ListArray.from_arrays(pa.array(b), values)
    return {
        "pack_id": pa.array(first_id + np.arange(rows)),
        "doc_ids": lists(keys.take(pa.array(owner[order]))),
        "doc_offsets": lists(pa.array(offset[order].astype(np.int64))),
        "cu_seqlens": lists(pa.array(bounds.astype(np.int32)), (begin + np.arange(rows + 1)).astype(np.int32)),
        "position_resets": lists(pa.array(start)),
        "input_ids": pa.array([r.tobytes() for r in matrix], pa.binary()),
    }


def pack(
    documents: DataFrame,
    vocabulary: str = VOCABULARY,
    length: int = LENGTH,
    end_of_text: int = END_OF_TEXT,
    block_tokens: int = BLOCK_TOKENS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Packed rows of all documents.

    ``pack_id``; ``doc_ids``, the key of each segment; ``doc_offsets``, where in
    its document's tokens a segment starts (0 but for later parts of a split
    document); ``cu_seqlens``, cumulative segment lengths from 0 to the tokens
    used; ``position_resets``, the places where position ids start again at 0;
    ``input_ids``, ``length`` little-endian unsigned integers of 2 bytes (4
    if an id needs it), filled up with ``end_of_text``.

    NULL and empty texts are one end-of-text id; repeated rows and keys and
    NULL keys are packed like any other; an empty table gives no row.
    ``vocabulary`` is read by the driver and sent along, about 0.5 MB.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()
    sent = documents.sparkSession.sparkContext.broadcast(content)
    largest = max(end_of_text, content.count(b"\n"))
    kind = np.uint16 if largest < 1 << 16 else np.uint32
    source = documents.select(documents[key].alias("k"), documents[text].alias("text"))
    key_type = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(sent.value)
        next_id = TaskContext.get().partitionId() << 33
        keys: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        gathered = 0

        def packed():
            nonlocal next_id, gathered
            columns = _pack(pa.concat_arrays(keys), tokens, length, end_of_text, kind, next_id)
            out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            next_id += out.num_rows
            gathered = 0
            keys.clear()
            tokens.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                at = 0
                for i, t in enumerate(part.column("text")):
                    ids = encode(encoder, t.as_py() or "").astype(kind)
                    tokens.append(np.append(ids, kind(end_of_text)))
                    gathered += len(ids) + 1
                    if gathered >= block_tokens:
                        keys.append(part.column("k").slice(at, i + 1 - at))
                        at = i + 1
                        yield packed()
                if at < part.num_rows:
                    keys.append(part.column("k").slice(at))
        if tokens:
            yield packed()

    return source.mapInArrow(
        run,
        f"pack_id bigint, doc_ids array<{key_type}>, doc_offsets array<bigint>, cu_seqlens array<int>, "
        "position_resets array<int>, input_ids binary",
    )


def segments(packs: DataFrame) -> DataFrame:
    """A row per segment: ``pack_id, doc_id, doc_offset``, its ``start`` and ``length`` in ``input_ids``."""
    one = packs.select(
        "pack_id", "cu_seqlens", "input_ids", F.posexplode(F.arrays_zip("doc_ids", "doc_offsets")).alias("_at", "_segment")
    )
    start, stop = (F.element_at("cu_seqlens", F.col("_at") + i) for i in (1, 2))
    return one.select(
        "pack_id", F.col("_segment.doc_ids").alias("doc_id"), F.col("_segment.doc_offsets").alias("doc_offset"),
        start.alias("start"), (stop - start).alias("length"), "input_ids",
    )
