"""Language-model scoring by cross-entropy difference.

A bigram model of the target texts and one of the background share one
vocabulary, the same smoothing and, by scaling the background's counts, the
same number of tokens.  A document's score is the mean over its tokens of
the target's loss less the background's: the lower, the more like the target.

Counts are taken over all texts and grow with them; words and pairs are known by hashes.  A token's loss is
``log(seen + pairs) - log(both + pairs * alone)``: one part of the word before it, one of the word and the pair.

1. Words are counted, and those pairs noted that are frequent somewhere.
2. The most frequent words, ``HEAD`` at most, and of the noted pairs the most frequent ones, ``PAIRS`` at most, get exact counts
   and are sent to the documents: what needs only these is worked out there.
3. All other tokens go by their pair, or by their word if that is not sent, in one shuffle in which those of target, background and
   documents meet.  There they are counted, so that no table of pairs is written, and what they add goes back by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadlab.llm.words import Words, lowered, mix, slices, split_words
from loadlab.session import stage

#: Smoothing takes the vocabulary for ``1 << WORD_BITS`` words.
WORD_BITS = 20
#: Words sent to all executors, 24 bytes each.  The others meet in a shuffle: results do not depend on it.
HEAD = 1 << 19
#: Pairs sent to all executors, 24 bytes each.
PAIRS = 1 << 19
#: A pair found as often among ``_AT_ONCE`` tokens may be sent.
_OFTEN = 4
#: Tokens a task holds before it hands their counts on.
_AT_ONCE = 1 << 20
_START = np.uint64(0x5851F42D4C957F2D)
#: Stands for the word before where a row asks for the word's own count.
_ALONE = np.int64(0x2545F4914F6CDD1D)
#: Keys of words that are not sent are negative, those of pairs with such a first word have this bit, those of other pairs are below it.
_MIXED = np.uint64(1 << 62)
#: In place of a document's number.
_TARGET, _BACKGROUND = -1, -2


@dataclass(frozen=True)
class Smoothing:
    """``words`` is added to every word of the vocabulary, ``pairs`` is the
    weight of the word's own probability among the pairs of a history."""

    words: float = 0.1
    pairs: float = 20.0


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of every token the word before it (``_START`` for none) and the pair."""
    before = np.empty_like(words.hash)
    before[1:] = words.hash[:-1]
    before[words.first[:-1][np.diff(words.first) > 0]] = _START
    return before, mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) ^ words.hash)


def _split(column: pa.Array) -> Words:
    return split_words(lowered(column), signs=True)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words, and of those pairs that are frequent here."""
    held: list[np.ndarray] = []

    def counted() -> Iterator[pa.RecordBatch]:
        for is_pair, keys in enumerate(np.concatenate(held, axis=1)):
            ids, n = np.unique(keys, return_counts=True)
            if is_pair:
                ids, n = ids[n >= _OFTEN], n[n >= _OFTEN]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array([bool(is_pair)] * len(ids), pa.bool_()), pa.array(n)], names=["id", "is_pair", "n"])
        held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            words = _split(part.column("text"))
            held.append(np.stack([words.hash, _pairs(words)[1]]))
            if sum(h.shape[1] for h in held) >= _AT_ONCE:
                yield from counted()
    if held:
        yield from counted()


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in a sorted table, -1 for none."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _count_sent(pairs):
    """Counts of the pairs that are sent, a task's at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pairs.value), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = _split(part.column("text"))
                before, pair = _pairs(words)
                at = _find(pairs.value, pair[before != _START])
                total += np.bincount(at[at >= 0], minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.value[there].view(np.int64)), pa.array(total[there])], names=["id", "n"])

    return run


def _of_both(count, target: DataFrame, background: DataFrame, keys: list[str], columns: str) -> DataFrame:
    """Counts ``t`` of the target and ``b`` of the background."""
    nothing, n = F.lit(0).cast("bigint"), F.col("n")
    parts = target.mapInArrow(count, columns).select(*keys, n.alias("t"), nothing.alias("b"))
    parts = parts.unionByName(background.mapInArrow(count, columns).select(*keys, nothing.alias("t"), n.alias("b")))
    return parts.groupBy(*keys).agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def _most_frequent(counts: DataFrame, most: int) -> list[np.ndarray]:
    """``id, t, b`` of the most frequent ones, by steps of a quarter of a power of two, sorted by their unsigned ``id``."""
    level = F.floor(4 * F.log2(F.greatest(F.col("t") + F.col("b"), F.lit(1)))).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    least, total = 1 << 20, 0
    for r in sorted(sizes, key=lambda r: -r.level):
        total += r.n
        if total > most:
            break
        least = r.level
    table = counts.where(level >= least).select("id", "t", "b").toArrow()
    ids = table["id"].to_numpy().view(np.uint64)
    order = np.argsort(ids)
    return [ids[order], *[table[c].to_numpy()[order].astype(float) for c in ("t", "b")]]


@dataclass(frozen=True)
class _Model:
    """Both models' losses from counts; ``total`` and ``by``, the scale of counts, of target and background."""

    smoothing: Smoothing
    total: tuple[int, int]
    by: tuple[float, float]

    def history(self, which: int, seen: np.ndarray) -> np.ndarray:
        return np.log(seen * self.by[which] + self.smoothing.pairs)

    def alone(self, which: int, itself: bool) -> int:
        """How often a pair of a document counts that nothing else has."""
        return int(which == 1 and itself)

    def word(self, which: int, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        s, by = self.smoothing, self.by[which]
        alone = (word * by + s.words) / (self.total[which] * by + s.words * (1 << WORD_BITS))
        return -np.log(pair * by + s.pairs * alone)


def _rows(words: Words, sent: tuple):
    """Of every token the word's place among those sent, the pair's and the word before's, which tokens begin a text, and for those that
    can't be scored from what is sent their place, ``key`` and ``sub``."""
    (head, *_), (often, *_) = sent
    before, pair = _pairs(words)
    at = _find(head, words.hash)
    past = np.concatenate(([-1], at[:-1]))[: len(at)]
    begins = np.zeros(len(at), dtype=bool)
    begins[words.first[:-1][np.diff(words.first) > 0]] = True
    past[begins] = -1
    both = _find(often, pair)
    both[begins] = -1
    open_ = np.flatnonzero((at < 0) | (both < 0) & ~begins)
    rare, mixed = at[open_] < 0, past[open_] < 0
    key = past[open_] * len(head) + at[open_]
    key = np.where(mixed, ((pair[open_] & (_MIXED - np.uint64(1))) | _MIXED).view(np.int64), key)
    key = np.where(rare, _word_key(words.hash[open_]), key)
    sub = np.where(rare, before[open_].view(np.int64), np.where(mixed, at[open_], 0))
    return at, both, past, begins, open_, key, sub


def _word_key(hash: np.ndarray) -> np.ndarray:
    return (hash | np.uint64(1 << 63)).view(np.int64)


def _merged(key: np.ndarray, sub: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal rows once, with how often they are there."""
    order = np.lexsort((sub, key, row))
    key, sub, row = key[order], sub[order], row[order]
    turns = np.ones(len(key), dtype=bool)
    turns[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(turns)
    return key[at], sub[at], row[at], np.diff(np.append(at, len(key)))


def _others(sent, number: int):
    """The target's or the background's tokens that are counted in the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                *_, key, sub = _rows(_split(part.column("text")), sent.value)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, _merged(key, sub, np.full(len(key), number)))), names=["key", "sub", "rid", "n"])

    return run


def _score(sent, model: _Model, itself: bool):
    """A row for each document with its tokens and what they add as far as is known, and one for each pair of a document that is not.

    Such a pair adds for now what it does where nothing else has it."""

    names = ["key", "sub", "rid", "n", "k", "t", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, *seen), (_, *pairs) = sent.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = _split(part.column("text"))
                at, both, past, begins, open_, key, sub = _rows(words, sent.value)
                row, n = words.row, np.diff(words.first)
                here = np.ones(len(at), dtype=bool)
                here[open_] = False
                sums = []
                for which in (0, 1):
                    add = np.zeros(len(at))
                    known = past >= 0
                    add[known] = model.history(which, seen[which][past[known]])
                    add[begins] = model.history(which, np.zeros(1))
                    often = np.where(both >= 0, pairs[which][both], 0.0) if len(pairs[which]) else np.zeros(len(at))
                    often[~here] = model.alone(which, itself)
                    add[at >= 0] += model.word(which, seen[which][at[at >= 0]], often[at >= 0])
                    sums.append(np.bincount(row, add, minlength=len(n)).astype(float))
                rid = part.column("rid").to_numpy()
                spread = ((mix(rid.astype(np.uint64)) & (_MIXED - np.uint64(1))) | _MIXED).view(np.int64)
                own = [part.column("k"), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (spread, np.zeros_like(rid), rid, n)), *own], names=names)
                # A word before that is not sent adds its part where it is counted.
                rare = np.flatnonzero((past < 0) & ~begins)
                asked = _word_key(words.hash[rare - 1])
                key, sub = np.concatenate([key, asked]), np.concatenate([sub, np.full(len(rare), _ALONE)])
                key, sub, of, often = _merged(key, sub, np.concatenate([row[open_], row[rare]]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key, sub, rid[of], often)), *[pa.nulls(len(of), c.type) for c in own]], names=names)

    return run


def _meet(sent, model: _Model, itself: bool):
    """Rows sorted by ``key``: what each adds to its document, by the counts of its pair and word; nothing more for a pair that is there once."""
    names = ["rid", "k", "n", "t", "b"]

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # Documents' own rows have sums.
        yield from table.filter(table["t"].is_valid()).select(names).to_batches()
        rest = table.filter(table["t"].is_null())
        key, sub, rid, n = (rest[c].to_numpy() for c in ("key", "sub", "rid", "n"))
        if not len(key):
            return
        # Words that are not sent come first; only theirs are different pairs of a key.
        order = np.arange(len(key))
        first = int(np.searchsorted(key, 0))
        order[:first] = np.lexsort((sub[:first], key[:first]))
        key, sub, rid, n = key[order], sub[order], rid[order], n[order]
        (head, *seen), _ = sent.value
        turn = np.concatenate(([False], key[1:] != key[:-1]))
        group = np.cumsum(turn)
        pair = np.cumsum(turn | np.concatenate(([False], sub[1:] != sub[:-1])))
        rare, mixed = key < 0, key >= np.int64(_MIXED)
        asks = rare & (sub == _ALONE)
        begins = rare & (sub == _START.view(np.int64))
        wanted = rid >= 0
        place = np.where(rare, 0, np.where(mixed, sub, key % max(1, len(head))))
        sums, more = [], rare.copy()
        for which in (0, 1):
            counts = rid == _TARGET if which == 0 else (wanted if itself else rid == _BACKGROUND)
            n_counted = np.where(counts & ~asks, n, 0)
            both = np.where(begins, 0.0, np.bincount(pair, n_counted)[pair])
            word = np.bincount(group, n_counted)[group]
            if len(head):
                word = np.where(rare, word, seen[which][place])
            alone = model.alone(which, itself)
            more |= both != alone
            add = model.word(which, word, both) - np.where(rare, 0.0, model.word(which, word, alone))
            sums.append(n * np.where(asks, model.history(which, word), add))
        wanted &= more
        rids, to = np.unique(rid[wanted], return_inverse=True)
        if len(rids):
            added = [pa.array(np.bincount(to, s[wanted], minlength=len(rids))) for s in sums]
            none = [pa.nulls(len(rids), table[c].type) for c in ("k", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(rids), *none, *added], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 16:
                continue
            last = batch.column("key").to_numpy()
            turns = np.flatnonzero(last[1:] != last[:-1])
            if len(turns):  # all but the last key are complete
                cut = int(turns[-1]) + 1
                yield from of(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from of(pa.Table.from_batches(held))

    return run


def cross_entropy_difference(
    documents: DataFrame,
    target: DataFrame,
    background: DataFrame | None = None,
    smoothing: Smoothing = Smoothing(),
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """``key, n_tokens, target_loss, background_loss, score`` for every document.

    The background is ``documents`` unless another table is given.  Texts
    without words, NULL ones too, have 0 tokens and NULL losses.  Repeated rows count as often as
    they are there.  An empty target or background leaves the uniform distribution.
    """
    context = documents.sparkSession.sparkContext
    itself = background is None
    of_target = target.select(target[target_text].alias("text"))
    of_background = (documents if itself else background).select(F.col(text).alias("text"))

    counts = stage(_of_both(_tally, of_target, of_background, ["id", "is_pair"], "id bigint, is_pair boolean, n bigint"), "word-counts")
    words = counts.where("not is_pair")
    total = tuple(words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("t", "b")]).first())
    head = _most_frequent(words, HEAD)
    often = context.broadcast(_most_frequent(counts.where("is_pair"), PAIRS)[0])
    pairs = _most_frequent(stage(_of_both(_count_sent(often), of_target, of_background, ["id"], "id bigint, n bigint"), "pair-counts"), PAIRS)
    sent = context.broadcast((head, pairs))
    model = _Model(smoothing, total, (1.0, total[0] / total[1] if all(total) else 1.0))

    source = documents.select(documents[key].alias("k"), documents[text].alias("text"))
    kind = source.schema["k"].dataType.simpleString()
    numbered = source.select(F.monotonically_increasing_id().alias("rid"), "k", "text")
    counted, own = "key bigint, sub bigint, rid bigint, n bigint", {"k": kind, "t": "double", "b": "double"}
    rows = numbered.mapInArrow(_score(sent, model, itself), f"{counted}, k {kind}, t double, b double")
    for texts, number in [(of_target, _TARGET), *([] if itself else [(of_background, _BACKGROUND)])]:
        rows = rows.unionByName(texts.mapInArrow(_others(sent, number), counted).select("*", *[F.lit(None).cast(t).alias(c) for c, t in own.items()]))
    dealt = rows.repartition("key").sortWithinPartitions("key")
    added = dealt.mapInArrow(_meet(sent, model, itself), f"rid bigint, k {kind}, n bigint, t double, b double")
    sums = added.groupBy("rid").agg(F.first("k", ignorenulls=True).alias("k"), F.max("n").alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    means = sums.select("k", "n", *[F.when(F.col("n") > 0, F.col(c) / F.col("n")).alias(c) for c in ("t", "b")])
    return means.select(
        F.col("k").alias(key), F.col("n").alias("n_tokens"), F.col("t").alias("target_loss"), F.col("b").alias("background_loss"),
        (F.col("t") - F.col("b")).alias("score"),
    )
