"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text, labelled or not,
is unlabelled.  A linear numpy classifier minimises the class-prior-corrected risk

    prior * E_P[l(s)] + max(0, E_U[l(-s)] - prior * E_P[l(-s)])

with the logistic loss ``l``: what looks toxic among the unlabelled is not held
against the model, and the second part can't fall below zero by overfitting.

Features are the words of a text and their first 4 and 6 bytes, so inflected
forms share evidence, hashed to ``1 << BITS`` places; present or absent.  Only
the ``most_features`` that differ most between positives and unlabelled carry weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadlab.llm.words import Words, lowered, mix, slices, split_words
from loadlab.session import stage

BITS = 20
PREFIXES = (4, 6)


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample and settings of the fit.  The sample is
    drawn by hash of the key, so it is the same in every run.  ``decay`` is the
    weight of the squared weights against the sum of losses."""

    most_positive: int = 4000
    most_unlabelled: int = 8000
    most_features: int = 4096
    steps: int = 200
    rate: float = 0.05
    decay: float = 1.0


@dataclass(frozen=True)
class Model:
    feature: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature and text row of everything found, repeats included."""
    mask = np.uint64((1 << BITS) - 1)
    row = words.row
    found, rows = [mix(words.hash) & mask], [row]
    for n in PREFIXES:
        long_enough = np.flatnonzero(words.end - words.start >= n)
        at = words.start[long_enough]
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + words.data[at + j]
        found.append(mix(h) & mask)
        rows.append(row[long_enough])
    return np.concatenate(found).astype(np.int64), np.concatenate(rows)


def present(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a row once."""
    both = np.unique((row << BITS) | feature)
    return both & ((1 << BITS) - 1), both >> BITS


def _found(batches: Iterator[pa.RecordBatch], text: str = "text"):
    for batch in batches:
        for part in slices(batch, text):
            yield part, *features(split_words(lowered(part.column(text)), signs=True))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the sample per feature, positives and unlabelled apart: one set of counts for a task."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for part, feature, row in _found(batches):
        feature, row = present(feature, row)
        positive = part.column("positive").to_numpy(zero_copy_only=False)[row]
        for side in (0, 1):
            counts[side] += np.bincount(feature[positive == bool(side)], minlength=1 << BITS)
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, counts[1, seen], counts[0, seen])], names=["feature", "p", "u"])


def fit(positive: np.ndarray, row: np.ndarray, column: np.ndarray, columns: int, prior: float, how: Training):
    """Weights and bias from a sparse 0/1 matrix by full-batch gradient steps.

    While the unlabelled part is below zero the step climbs that part instead,
    as the non-negative estimator prescribes.
    """
    n = len(positive)
    p = np.where(positive, 1 / max(1, positive.sum()), 0.0)
    u = np.where(positive, 0.0, 1 / max(1, n - positive.sum()))
    w = np.zeros(columns + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def of_rows(values):
        return np.bincount(row, values[column], minlength=n) + values[-1]

    for step in range(1, how.steps + 1):
        s = of_rows(w)
        toxic = 1 / (1 + np.exp(-s))
        clean_loss = np.logaddexp(0, s)
        negative_risk = (u - prior * p) @ clean_loss
        by_score = prior * p * (toxic - 1) + (u - prior * p) * toxic if negative_risk >= 0 else -(u - prior * p) * toxic
        g = np.append(np.bincount(column, by_score[row], minlength=columns), by_score.sum())
        g[:-1] += how.decay / n * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _positive(texts: DataFrame, toxic: DataFrame, most: int) -> DataFrame:
    """``positive, text`` of at most ``most`` rows with a toxic key, drawn by hash."""
    draw = F.xxhash64("k")
    # At most ``most`` keys; a key may have any number of rows.
    keys = toxic.orderBy(draw, "k").limit(most)
    rows = texts.join(F.broadcast(keys), "k").orderBy(draw, "k", F.xxhash64("text"), "text").limit(most)
    return rows.select(F.lit(True).alias("positive"), "text")


def _drawn(texts: DataFrame, most: int) -> DataFrame:
    """``positive, text`` of ``most`` rows, or all if there are fewer, drawn by hash.

    Only rows below a bound of the hash, chosen by their number, come together to be put in order.
    """
    draw = F.xxhash64("k")
    below = F.lit(True)
    total = texts.count()
    if total > 4 * most:
        bound = draw < F.lit(-(1 << 63) + int((1 << 64) * 2 * most / total))
        # Where rows repeat a key the bound may leave too few.
        below = bound if texts.where(bound).count() >= most else below
    rows = texts.where(below).orderBy(draw, "k", F.xxhash64("text"), "text").limit(most)
    return rows.select(F.lit(False).alias("positive"), "text")


def train(documents: DataFrame, labels: DataFrame, how: Training = Training(), key: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample.

    ``labels`` has ``key`` and ``toxic``; hand in only rows that may be learnt
    from.  The class prior is the share of toxic rows in it.  Unlabelled texts
    are drawn from all ``documents`` handed in.  Without a positive row the model knows nothing and
    calls every text clean; NULL keys and NULL labels are left out.  Rows are drawn, not keys: a key that is
    repeated, toxic or not, makes the sample no larger.
    """
    known = labels.where(labels[key].isNotNull() & labels["toxic"].isNotNull()).select(labels[key].alias("k"), "toxic")
    prior = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0]
    if not prior:
        return Model(np.zeros(0, np.int64), np.zeros(0), -6.0, 0.0)
    prior = min(prior, 0.9)
    texts = documents.select(documents[key].alias("k"), documents[text].alias("text")).where("k is not null")
    toxic = known.where("toxic = 1").select("k").distinct()
    sample = stage(_positive(texts, toxic, how.most_positive).unionByName(_drawn(texts, how.most_unlabelled)), "toxicity-sample")

    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Model(np.zeros(0, np.int64), np.zeros(0), -6.0, prior)
    seen = sample.mapInArrow(_frequencies, "feature long, p long, u long").groupBy("feature").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u")
    )
    rate = (F.col("p") + F.col("u")) / (n_p + n_u)
    apart = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u) + 1e-12)
    # A fixed number of rows, whatever the sample.
    rows = seen.orderBy(apart.desc(), "feature").limit(how.most_features).select("feature").collect()
    chosen_features = np.sort(np.array([r[0] for r in rows], dtype=np.int64))

    def known_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = np.full(1 << BITS, -1, dtype=np.int32)
        lookup[chosen_features] = np.arange(len(chosen_features))
        for part, feature, row in _found(batches):
            at = lookup[feature]
            at, row = present(at[at >= 0].astype(np.int64), row[at >= 0])
            cut = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("positive"), lists], names=["positive", "at"])

    table = sample.mapInArrow(known_features, "positive boolean, at array<int>").toArrow()
    positive = table["positive"].to_numpy()
    at = table["at"].combine_chunks()
    lengths = np.diff(np.asarray(at.offsets))
    column = at.flatten().to_numpy()
    weight, bias = fit(positive, np.repeat(np.arange(len(positive)), lengths), column, len(chosen_features), prior, how)
    return Model(chosen_features, weight, bias, prior)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``key``, the columns of ``keep`` and ``score`` from 0 to 1 for every row, by its whole text.

    One pass, no shuffle; the model sent along has at most ``most_features``
    weights.  NULL and empty texts, without any feature, get the score of the
    bias alone.
    """
    names = [key, *keep]
    source = documents.select(*[documents[c].alias(f"c{i}") for i, c in enumerate(names)], documents[text].alias("text"))
    table = documents.sparkSession.sparkContext.broadcast((model.feature, model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature_ids, weight, bias = table.value
        weights = np.zeros(1 << BITS)
        weights[feature_ids] = weight
        for part, feature, row in _found(batches):
            carries = weights[feature] != 0
            feature, row = present(feature[carries], row[carries])
            s = np.bincount(row, weights[feature], minlength=part.num_rows) + bias
            scores = pa.array(1 / (1 + np.exp(-np.clip(s, -500, 500))))
            yield pa.RecordBatch.from_arrays([*[part.column(f"c{i}") for i in range(len(names))], scores], names=[*names, "score"])

    types = ", ".join(f"`{c}` {source.schema[f'c{i}'].dataType.simpleString()}" for i, c in enumerate(names))
    return source.mapInArrow(run, f"{types}, score double")
