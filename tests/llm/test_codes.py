import hashlib
import math

import numpy as np
import pytest

from loadlab.llm import blocks, codes

NAN, INF = float("nan"), float("inf")


def brute(rows, parts, entries, rounds, factor=1024):
    """``{(key, vector): (code, error, label error)}`` and the digest, by comparing everything with every entry."""
    kept = [(k, [math.floor(factor * x) for x in v], label) for k, v, label in rows]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def assigned():
        found = []
        for _, x, _ in kept:
            near = []
            for p in range(parts):
                part = x[p * width : (p + 1) * width]
                away = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in books[p]]
                near.append((away.index(min(away)), min(away)))
            found.append(near)
        return found

    for _ in range(rounds):
        near = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p * width : (p + 1) * width] for (_, x, _), n in zip(kept, near) if n[p][0] == e]
                if mine:
                    books[p][e] = [sum(column) // len(mine) for column in zip(*mine)]
    near = assigned()
    errors = [sum(d for _, d in n) for n in near]
    of_label = {}
    for (_, _, label), e in zip(kept, errors):
        of_label[label] = of_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(k, "".join(f"{e:02x}" for e, _ in n), d, of_label[label]) for (k, _, label), n, d in zip(kept, near, errors)], digest


def table(draw, n, dimension):
    """Families of near vectors, exact copies, ties half way between entries, repeated and NULL keys and labels."""
    bases = draw.integers(-600, 600, (9, dimension))
    rows = []
    for i in range(n):
        v = bases[draw.integers(0, 9)] + draw.integers(-30, 31, dimension) * draw.choice([0, 0, 1, 8])
        rows.append((int(draw.integers(0, n)), [float(x) / 1024 for x in v], draw.choice([None, 0, 1, 2])))
    rows += [(None, rows[0][1], None), rows[1], (rows[1][0], rows[2][1], 1)]
    return [(k, v, None if label is None else int(label)) for k, v, label in rows]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("leaf,block", [(32, 4096), (3, 50)])
def test_against_every_entry(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(codes, "LEAF", leaf)
    monkeypatch.setattr(blocks, "BLOCK", block)
    rows = table(np.random.default_rng(3), 400, 8)
    expected, digest = brute(rows, 4, 20, 3)
    got = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=20, rounds=3).collect()
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=str) == sorted(expected, key=str)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_walk_agrees_with_comparing_all():
    draw = np.random.default_rng(1)
    for scale, n in ((5, 700), (400, 900), (100_000, 300)):
        points = draw.integers(-scale, scale + 1, (n, 4))
        points[: n // 3] = points[0]
        entries = np.concatenate([points[:: n // 20], points[:5], draw.integers(-scale, scale, (6, 4))]).astype(np.int64)
        away = ((points[:, None] - entries) ** 2).sum(axis=2)
        t = codes.tree(points)
        code, error = codes.nearest(t, entries)
        assert (code == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
        count, total = codes.sums(t, entries)
        assert (count == np.bincount(code, minlength=len(entries))).all()
        assert all((total[e] == points[code == e].sum(axis=0)).all() for e in range(len(entries)))
        # Balls cover all that lies below them and cache its sum.
        for a, b, s, r in zip(t.start, t.stop, t.sums, t.radius):
            inside = t.points[a:b]
            assert (inside.sum(axis=0) == s).all() and np.sqrt(((inside - s / (b - a)) ** 2).sum(axis=1)).max() <= r * (1 + 1e-9)
        assert (points[t.place] == t.points).all()


def test_whole_balls_are_owned():
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.integers(-9, 10, (500, 4)) + c for c in ([0] * 4, [2000] * 4, [-3000] * 4)])
    t = codes.tree(points)
    balls, _, entry = codes.walk(t, np.array([[1] * 4, [2000] * 4, [-3000] * 4, [50_000] * 4]))
    assert (entry < 0).all() and len(balls) < 40 and (t.stop[balls] - t.start[balls]).sum() == 1500


def test_odd_rows(spark):
    rows = [
        (1, [0.5, 1.0, -0.25, 2.0], 1), (2, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [NAN, 1.0, 1.0, 1.0], 1), (5, [INF, 1.0, 1.0, 1.0], 1),
        (6, [1.0, 2.0], 1), (7, [], None), (8, [1e30, 0.0, 0.0, 0.0], 2), (9, [0.5, 1.0, -0.25, 2.001], 1), (None, [0.0, 0.0, 0.0, 0.0], None),
    ]
    df = spark.createDataFrame([(*r, "a", 0) for r in rows], SCHEMA + ", code string, x int")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.compress(df).collect()}
    assert set(got) == {1, 6, 7, 8, 9, None}
    assert [got[k][1:] for k in (1, 9, None)] == [(0, 0)] * 3 and len({got[k][0] for k in (1, 9, None)}) == 3
    assert got[6] == (None, None, 0) and got[7][:2] == (None, None) and got[8] == (None, None, None)
    assert codes.compress(df.limit(0)).collect() == []
    assert codes.compress(df.where("vec_id = 2")).collect() == []
    assert [r.code for r in codes.compress(df.where("vec_id = 7")).collect()] == [None]
