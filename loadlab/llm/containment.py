"""Benchmark decontamination: test items inside documents.

An item is contained in a document if the document has at least ``threshold``
of the item's distinct word shingles.  Items are partitioned by size; each
partition keeps so many of an item's smallest shingle hashes (its MinHash
signature) that a document with enough of the item must have some of them: of
``n`` shingles ``n - needed`` may be missing, so of the ``n - needed + spare``
smallest at least ``spare`` are there.  Documents are asked by the same rule:
only their hashes below the largest value any signature of the partition holds
are looked up.  What is found is verified by exact containment, so no
contained item is lost and none is reported in error.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadlab.llm.words import lowered, shingles, slices, split_words

WIDTH = 5
THRESHOLD = 0.8
#: Bytes of item text in one block of queries; each block is one pass over the documents.
BLOCK_BYTES = 8 << 20
_LOOKUP_BITS = 22


class _Partition:
    """Items of one shingle width and one power of two of sizes."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        self.items = [i for i, _ in items]
        self.sets = [s for _, s in items]
        size = np.array([len(s) for s in self.sets])
        self.needed = np.array([ceil(threshold * n - 1e-9) for n in size])
        spare = np.minimum(self.needed, 4)
        kept = np.minimum(size, size - self.needed + spare)
        self.least = kept - (size - self.needed)
        keys = np.concatenate([s[:k] for s, k in zip(self.sets, kept)])
        owner = np.repeat(np.arange(len(items)), kept)
        order = np.argsort(keys, kind="stable")
        self.owner = owner[order]
        self.keys, self.begin = np.unique(keys[order], return_index=True)
        self.stop = np.append(self.begin[1:], len(order))
        self.largest = self.keys[-1]
        self.bitmap = np.zeros(1 << _LOOKUP_BITS, dtype=bool)
        self.bitmap[self.keys & np.uint64((1 << _LOOKUP_BITS) - 1)] = True

    @classmethod
    def of(cls, state: dict) -> _Partition:
        """From the attributes of another one: plain arrays travel, whatever the workers can import."""
        own = cls.__new__(cls)
        own.__dict__.update(state)
        return own

    def search(self, hash: np.ndarray, row: np.ndarray):
        """``(row, item place)`` of the candidates."""
        near = np.flatnonzero(self.bitmap[hash & np.uint64((1 << _LOOKUP_BITS) - 1)] & (hash <= self.largest))
        at = np.searchsorted(self.keys, hash[near])
        same = self.keys[at] == hash[near]
        if not same.any():
            return np.zeros((2, 0), dtype=np.int64)
        pairs = np.unique(np.stack([row[near][same], at[same]]), axis=1)
        times = self.stop[pairs[1]] - self.begin[pairs[1]]
        owner = self.owner[np.concatenate([np.arange(self.begin[a], self.stop[a]) for a in pairs[1]])]
        hits, count = np.unique(np.stack([np.repeat(pairs[0], times), owner]), axis=1, return_counts=True)
        return hits[:, count >= self.least[hits[1]]]


def _partitions(texts: pa.Array, threshold: float, width: int) -> dict[int, list[_Partition]]:
    """By shingle width: an item of fewer words than ``width`` is one shingle of all its words."""
    words = split_words(lowered(texts), signs=True)
    hash, row = shingles(words.hash, words.first, width)
    counts = np.diff(words.first)
    groups: dict[tuple[int, int], list] = {}
    cut = np.searchsorted(row, np.arange(words.n + 1))
    for i in range(words.n):
        own = np.unique(hash[cut[i] : cut[i + 1]])
        if len(own):
            groups.setdefault((min(width, counts[i]), len(own).bit_length()), []).append((i, own))
    found: dict[int, list[_Partition]] = {}
    for (w, _), items in groups.items():
        found.setdefault(int(w), []).append(_Partition(items, threshold))
    return found


def _blocks(items: DataFrame, threshold: float, width: int, item_key: str, item_text: str, block_bytes: int):
    """The items, block by block, each sent to the executors."""
    wanted = items.select(items[item_key].alias("item"), items[item_text].alias("text")).where("text is not null and text <> ''")
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).toArrow()
        parts = _partitions(own["text"].combine_chunks(), threshold, width)
        index = (own["item"].combine_chunks(), {w: [vars(p) for p in group] for w, group in parts.items()})
        yield items.sparkSession.sparkContext.broadcast(index)


def _opened(index: tuple) -> tuple[pa.Array, dict[int, list[_Partition]]]:
    names, states = index
    return names, {w: [_Partition.of(s) for s in group] for w, group in states.items()}


def _hits(texts: pa.Array, partitions: dict[int, list[_Partition]]) -> Iterator[tuple[int, int, int, int]]:
    """Row, item, its shingles and how many are shared, for what is contained."""
    words = split_words(lowered(texts), signs=True)
    for width, groups in partitions.items():
        hash, row = shingles(words.hash, words.first, width, whole_if_short=False)
        for group in groups:
            for r, at in group.search(hash, row).T:
                own = hash[np.searchsorted(row, r) : np.searchsorted(row, r + 1)]
                both = int(np.isin(group.sets[at], own).sum())
                if both >= group.needed[at]:
                    yield int(r), group.items[at], len(group.sets[at]), both


def contained(
    documents: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``key, item_key, item_shingles, shared, containment`` for every document row and contained item.

    Words are lower-cased runs without blanks and ASCII signs.  NULL and empty
    texts hold nothing and are contained in nothing; repeated documents and
    items are each reported.  The items are the query set: they are taken in
    blocks of about ``block_bytes``, one pass over the documents for each, so
    what is sent to the executors is bounded.
    """
    source = documents.select(documents[key].alias("k"), documents[text].alias("text"))
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((documents, key), (items, item_key)))
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, item_shingles bigint, shared bigint, containment double"

    def search(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, partitions = _opened(index.value)
            for batch in batches:
                for part in slices(batch, "text"):
                    found = list(_hits(part.column("text"), partitions))
                    rows, at, sizes, shared = ([f[i] for f in found] for i in range(4))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("k").take(pa.array(rows, pa.int64())),
                            names.take(pa.array(at, pa.int64())),
                            pa.array(sizes, pa.int64()),
                            pa.array(shared, pa.int64()),
                            pa.array([a / b for a, b in zip(shared, sizes)], pa.float64()),
                        ],
                        names=[key, item_key, "item_shingles", "shared", "containment"],
                    )

        return run

    result = None
    for index in _blocks(items, threshold, width, item_key, item_text, block_bytes):
        found = source.mapInArrow(search(index), schema)
        result = found if result is None else result.unionByName(found)
    return result


def without(
    documents: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that contain none of the items, all columns as they are.  No shuffle."""
    kept = documents
    for index in _blocks(items, threshold, width, item_key, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            _, partitions = _opened(index.value)
            for batch in batches:
                for part in slices(batch, text):
                    clean = np.ones(part.num_rows, dtype=bool)
                    clean[[f[0] for f in _hits(part.column(text), partitions)]] = False
                    yield part.filter(pa.array(clean))

        kept = kept.mapInArrow(run, documents.schema)
    return kept
