import hashlib
import math

import numpy as np

from loadlab.llm import blocks, centroids


def brute(rows, size, rounds, factor=64, seed=1):
    kept = [(k, [math.floor(factor * x) for x in v]) for k, v in rows]
    rank = lambda k: (k is None, "" if k is None else hashlib.sha256(f"{seed}:{k}".encode()).hexdigest())
    middles = [x for _, x in sorted(kept, key=lambda r: (*rank(r[0]), r[1]))[:size]]

    def assigned():
        found = []
        for _, x in kept:
            away = [sum((a - b) ** 2 for a, b in zip(x, m)) for m in middles]
            found.append((away.index(min(away)), min(away)))
        return found

    for _ in range(rounds):
        near = assigned()
        for c in range(len(middles)):
            mine = [x for (_, x), (e, _) in zip(kept, near) if e == c]
            if mine:
                middles[c] = [sum(column) // len(mine) for column in zip(*mine)]
    near = assigned()
    per = {}
    for c, d in near:
        per[c] = per.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return [(k, c, d, per[c], sum(per.values()), digest[c]) for (k, _), (c, d) in zip(kept, near)]


SCHEMA = "vec_id long, embedding array<double>"


def families(draw, n, dimension):
    bases = draw.integers(-80, 80, (12, dimension))
    rows = []
    for i in range(n):
        v = bases[draw.integers(0, 12)] + draw.integers(-9, 10, dimension) * draw.choice([0, 1, 3])
        rows.append((i, [float(x) / 64 for x in v]))
    return rows


def test_against_every_centroid(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = families(draw, 700, 6)
    rows += [(None, rows[0][1]), rows[1], (rows[1][0], rows[2][1])]
    for block, size, rounds in ((4096, 16, 3), (37, 9, 4), (64, 1, 2), (64, 700, 1)):
        monkeypatch.setattr(blocks, "BLOCK", block)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = centroids.cluster(df, size=size, rounds=rounds, dimension=6)
        assert got.dtypes[1:] == [(n, t) for n, t in zip(
            ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), ("int", "bigint", "bigint", "bigint", "string"))]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, size, rounds), key=str)


def test_only_expired_gaps_are_scanned():
    draw = np.random.default_rng(7)
    middles = np.array([[0, 0], [1000, 0], [0, 1000]])
    points = (middles[draw.integers(0, 3, 900)] + draw.integers(-450, 451, (900, 2))).astype(np.int32)
    block = centroids.Block(points, 3)
    block.update(middles, np.zeros(3))
    assert block.scanned == 900
    used, scanned = np.zeros(3), []
    for _ in range(6):
        away = draw.integers(-40, 41, (3, 2))
        used = used + centroids._drift(middles, middles + away)
        middles = middles + away
        block = centroids.Block.read({k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in block.stored().items()}, 2)
        block.update(middles, used)
        scanned.append(block.scanned)
        assert (block.cluster == blocks.squared(points, middles).argmin(axis=1)).all()
        assert sorted(m for heap in block.heaps for _, m in heap) == list(range(900))
    assert 0 < sum(scanned) < 900 * 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [-inf, 1.0]), (6, [1.0]), (7, []), (8, [1e30, 0.0]),
        (9, [0.5, 1.25]), (None, [0.0, 0.0]), (9, [0.5, 1.25]),
    ]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", cluster int, k string")
    got = centroids.cluster(df, dimension=2).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "8", "9", "9", "None"]
    expected = brute([r for r in rows if r[0] in (1, 9, None)], 16, 3)
    assert sorted((tuple(r) for r in got if r.vec_id != 8), key=str) == sorted(expected, key=str)
    assert [tuple(r) for r in got if r.vec_id == 8] == [(8, None, None, None, None, None)]
    assert centroids.cluster(df.limit(0)).collect() == [] and centroids.cluster(df.where("vec_id = 7")).collect() == []
