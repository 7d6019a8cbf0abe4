"""Vector code compression: a codebook per part of the vectors, trained by k-means on metric trees.

Vectors are whole numbers and are cut into parts.  Blocks of rows get, once, an
anchors hierarchy for each part: about as many anchors as the root of the number
of points, each new one the farthest point of the widest anchor, taking the points that are
nearer to it; anchors are merged pairwise from the middle up, the pair with the smallest ball first,
and cut further from the middle down.  Each ball caches count and sum of its points.  A round walks the
balls from the root with the list of entries that can still be nearest to one of
its points, inherited from the ball above; a ball left with one entry gives its count
and sum without a look at its points, and only points of the last, undecided balls are
compared, with the entries of their list.

Trees are built once and staged; a round reads them and returns a row per entry and task.
All distances are whole numbers held exactly, so results do not depend on blocks or tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loadlab.llm import blocks
from loadlab.session import fits_broadcast, stage

LEAF = 32
FACTOR = 1024

#: A stored tree: the bytes of each of its arrays.
_TREE = ("points", "place", "start", "stop", "left", "right", "radius", "sums")


class Tree:
    """Balls in arrays, the root first.  Points lie in the order of the balls; ``place`` says where each came from."""

    def __init__(self, points, place, start, stop, left, right, radius, sums):
        self.points, self.place = points, place
        self.start, self.stop, self.left, self.right, self.radius, self.sums = start, stop, left, right, radius, sums

    @classmethod
    def read(cls, stored: dict, width: int) -> Tree:
        of = lambda name, kind: np.frombuffer(stored[name], dtype=kind)
        whole = {n: of(n, np.int32) for n in ("place", "start", "stop", "left", "right")}
        return cls(of("points", np.int32).reshape(-1, width), radius=of("radius", float), sums=of("sums", np.int64).reshape(-1, width), **whole)

    def stored(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in _TREE}


def _anchors(points: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """``at`` cut into the points of each anchor."""
    mine = points[at]
    owner = np.zeros(len(at), dtype=np.int32)
    pivots = mine[:1]
    reach = np.sqrt(((mine - mine[0]) ** 2).sum(axis=1))
    for number in range(1, int(np.ceil(len(at) ** 0.5))):
        # Of the widest anchor, the point farthest from its pivot.
        far = int(reach.argmax())
        if reach[far] == 0:
            break
        new = mine[far]
        half = np.sqrt(((pivots - new) ** 2).sum(axis=1)) / 2
        # Points nearer to their pivot than half the way to the new one can't be nearer to that.
        open_ = np.flatnonzero(reach >= half[owner])
        away = np.sqrt(((mine[open_] - new) ** 2).sum(axis=1))
        nearer = away < reach[open_]
        owner[open_[nearer]], reach[open_[nearer]] = number, away[nearer]
        pivots = np.vstack([pivots, new])
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    return [at[part] for part in np.split(order, cuts)]


def _merged(balls: list[tuple]) -> tuple:
    """One ball ``(centre, radius, count, left, right or points)`` of many: always the two whose common ball is smallest."""
    held = list(balls)
    n = len(held)
    centre = np.array([b[0] for b in held])
    radius, count = np.array([b[1] for b in held]), np.array([b[2] for b in held], dtype=float)

    def wide(i: int) -> np.ndarray:
        """Radius of the ball of ``i`` with each other one, about the middle of both."""
        apart = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
        share = count[i] / (count + count[i])
        return np.maximum(apart * share + radius, apart * (1 - share) + radius[i])

    width = np.array([wide(i) for i in range(n)])
    width[np.arange(n), np.arange(n)] = np.inf
    for _ in range(n - 1):
        i, j = np.unravel_index(width.argmin(), width.shape)
        total = count[i] + count[j]
        middle = (centre[i] * count[i] + centre[j] * count[j]) / total
        held[i] = (middle, width[i, j], total, held[i], held[j])
        centre[i], radius[i], count[i] = middle, width[i, j], total
        width[j, :] = width[:, j] = np.inf
        row = wide(i)
        row[np.isinf(width).all(axis=1)] = np.inf
        row[i] = row[j] = np.inf
        width[i, :] = width[:, i] = row
        held[j] = None
    return next(b for b in held if b is not None)


def _grown(points: np.ndarray, at: np.ndarray) -> tuple:
    mine = points[at]
    centre = mine.mean(axis=0)
    radius = float(np.sqrt(((mine - centre) ** 2).sum(axis=1).max()))
    if len(at) > LEAF and radius > 0:
        parts = _anchors(points, at)
        if len(parts) > 1:
            return _merged([_grown(points, part) for part in parts])
    return centre, radius, len(at), at


def tree(points: np.ndarray) -> Tree:
    """The anchors hierarchy of whole-number points, at least one."""
    real = points.astype(float)
    root = _grown(real, np.arange(len(points)))
    start, stop, left, right, place = [], [], [], [], []

    def number(ball: tuple) -> int:
        for column, empty in ((start, 0), (stop, 0), (left, -1), (right, -1)):
            column.append(empty)
        return len(start) - 1

    # Depth first, so that the points of a ball lie together; a ball's end is known when all below it is placed.
    waiting = [(root, number(root), False)]
    while waiting:
        ball, i, done = waiting.pop()
        if done:
            stop[i] = len(place)
            continue
        start[i] = len(place)
        if len(ball) == 4:
            place.extend(ball[3].tolist())
            stop[i] = len(place)
        else:
            left[i], right[i] = number(ball[3]), number(ball[4])
            waiting += [(ball, i, True), (ball[4], right[i], False), (ball[3], left[i], False)]
    order = np.array(place, dtype=np.int32)
    mine = points[order]
    summed = np.vstack([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(mine, axis=0, dtype=np.int64)])
    start, stop = np.array(start, dtype=np.int32), np.array(stop, dtype=np.int32)
    sums = summed[stop] - summed[start]
    radius = np.array([
        np.sqrt(((mine[a:b] - s / (b - a)) ** 2).sum(axis=1).max()) for a, b, s in zip(start, stop, sums)
    ])
    return Tree(mine.astype(np.int32), order, start, stop, np.array(left, dtype=np.int32), np.array(right, dtype=np.int32), radius, sums)


def _candidates(entries: np.ndarray) -> np.ndarray:
    """Entries that can be nearest: of equal ones the first."""
    first = np.unique(entries, axis=0, return_index=True)[1]
    can = np.zeros(len(entries), dtype=bool)
    can[first] = True
    return can


def walk(t: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(balls, entry of each, entry of each point or -1)``: balls owned by one entry, and the points of no owned ball."""
    real = entries.astype(float)
    apart = np.sqrt(np.maximum(blocks.squared(real, real), 0))
    scale = max(float(np.abs(t.points).max(initial=0)), float(np.abs(real).max(initial=0)), 1.0) ** 2 * real.shape[1]
    at, can = np.zeros(1, dtype=np.int64), _candidates(entries)[None, :]
    owned, owners, undecided, lists = [], [], [], []
    while len(at):
        centre = t.sums[at] / (t.stop[at] - t.start[at])[:, None]
        away = np.where(can, blocks.squared(centre, real), np.inf)
        best = away.argmin(axis=1)
        least = away[np.arange(len(at)), best]
        # An entry is out if the whole ball lies on the other side of the plane in the middle of it and the best one.
        with np.errstate(invalid="ignore"):
            out = away - least[:, None] > 2 * apart[best] * (t.radius[at] * (1 + 1e-9) + 1e-9)[:, None] + 1e-11 * scale
        out[np.arange(len(at)), best] = False
        can = can & ~out
        one = can.sum(axis=1) == 1
        owned.append(at[one]), owners.append(best[one])
        last = ~one & (t.left[at] < 0)
        undecided.append(at[last]), lists.append(can[last])
        inner = ~one & ~last
        can = np.concatenate([can[inner], can[inner]])
        at = np.concatenate([t.left[at[inner]], t.right[at[inner]]]).astype(np.int64)
    entry = np.full(len(t.points), -1, dtype=np.int64)
    ball, can = np.concatenate(undecided), np.concatenate(lists)
    for a in range(0, len(ball), 64):
        some = ball[a : a + 64]
        sizes = t.stop[some] - t.start[some]
        rows = np.repeat(t.start[some] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        near = np.where(np.repeat(can[a : a + 64], sizes, axis=0), blocks.squared(t.points[rows], real), np.inf)
        entry[rows] = near.argmin(axis=1)
    return np.concatenate(owned), np.concatenate(owners), entry


def sums(t: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points nearest to each entry; ties go to the lower one."""
    count, total = np.zeros(len(entries), dtype=np.int64), np.zeros(entries.shape, dtype=np.int64)
    balls, owners, entry = walk(t, entries)
    np.add.at(count, owners, t.stop[balls] - t.start[balls])
    np.add.at(total, owners, t.sums[balls])
    seen = entry >= 0
    np.add.at(count, entry[seen], 1)
    np.add.at(total, entry[seen], t.points[seen].astype(np.int64))
    return count, total


def nearest(t: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each point, in the order the points were given."""
    balls, owners, entry = walk(t, entries)
    for a, b, e in zip(t.start[balls], t.stop[balls], owners):
        entry[a:b] = e
    error = ((t.points.astype(np.int64) - entries[entry]) ** 2).sum(axis=1)
    code, distance = np.empty(len(entry), dtype=np.int64), np.empty(len(entry), dtype=np.int64)
    code[t.place], distance[t.place] = entry, error
    return code, distance


def _planted(parts: int, width: int):
    def work(rows: pa.Table) -> dict:
        points = blocks.matrix(rows["x"], parts * width)
        trees = [tree(points[:, p * width : (p + 1) * width]).stored() for p in range(parts)]
        kind = pa.struct([(name, pa.binary()) for name in _TREE])
        return {"k": rows["k"], "label": rows["label"], "trees": pa.array(trees, kind)}

    return work


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[list[Tree]]:
    for stored in batch.column("trees"):
        yield [Tree.read(s, width) for s in stored.as_py()]


def _summed(books: np.ndarray):
    """For ``mapInArrow`` over blocks: what each entry of each part owns in a task."""
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, size), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for trees in _trees(batch, width):
                for p, t in enumerate(trees):
                    n, s = sums(t, books[p])
                    count[p] += n
                    total[p] += s
        p, e = np.nonzero(count)
        of = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(of, names=["part", "entry", "n", "s"])

    return run


def _coded(books: np.ndarray):
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, trees in enumerate(_trees(batch, width)):
                found = [nearest(t, books[p]) for p, t in enumerate(trees)]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                held = [batch.column(c)[row].values for c in ("k", "label")]
                error = sum(f[1] for f in found)
                yield pa.RecordBatch.from_arrays(
                    [*held, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["k", "label", "code", "error"]
                )

    return run


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    factor: int = FACTOR,
) -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256`` for every row with a sound vector.

    A vector that is NULL or holds a NULL, NaN or infinite component is left out.  Components
    are ``floor(factor * x)``.  Each part's codebook starts as that part of the first ``entries``
    vectors by key (NULL last, then by components) and has at most 256 entries; ``rounds`` times all parts
    are assigned to their nearest entry and each entry with parts becomes their mean, rounded down.
    ``code`` is two hexadecimal digits a part, ``error`` the squared distance, ``label_error`` its sum over rows of the same
    label, NULL being one.  The dimension is that of the first vector by key that ``parts`` divides;
    vectors of another dimension, and those with a component beyond what keeps distances exact (about eight
    thousand before scaling with 64 components), have NULL code and error.  Repeated rows count each; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two digits: 1 to 256 entries")
    columns = [vectors[key].alias("k"), vectors[label].alias("label"), blocks.floored(vectors[vector], factor).alias("x")]
    sound = vectors.select(*columns).where("x is not null")
    usable = sound.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    by = F.struct(F.col("k").isNull(), "k", "x")
    dimension = usable.agg(F.min_by(F.size("x"), by)).first()[0] or parts
    width = dimension // parts
    fits = blocks.within(F.col("x"), dimension)
    kind = sound.schema["k"].dataType.simpleString(), sound.schema["label"].dataType.simpleString()

    first = blocks.smallest(sound.where(fits).select(F.col("k").alias("rank"), "x"), entries).reshape(-1, parts, width)
    books = np.ascontiguousarray(first.transpose(1, 0, 2))
    fields = ", ".join(f"{name}: binary" for name in _TREE)
    schema = f"k array<{kind[0]}>, label array<{kind[1]}>, trees array<struct<{fields}>>"
    planted, _ = blocks.in_blocks(sound.where(fits), _planted(parts, width), schema, "trees")
    for _ in range(rounds if books.size else 0):
        owned = planted.select("trees").mapInArrow(_summed(books), "part int, entry int, n bigint, s array<bigint>")
        total = owned.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
        books = books.copy()
        # One row per entry of a codebook, whatever the number of vectors.
        for part, entry, n, *s in total.collect():
            books[part, entry] = [value // n for value in s]

    coded = planted.mapInArrow(_coded(books), f"k {kind[0]}, label {kind[1]}, code string, error bigint")
    others = sound.where(~fits).select("k", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stage(coded.unionByName(others), "coded")
    return _with_label_error(coded).select(
        F.col("k").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _with_label_error(coded: DataFrame) -> DataFrame:
    per = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    per = stage(per, "label-errors")
    beside = F.broadcast(per) if fits_broadcast(per, blocks.label_texts(per, ["of"])) else per
    same: Column = coded["label"].eqNullSafe(beside["of"])
    return coded.join(beside, same)
