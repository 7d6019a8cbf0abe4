import random

from loadlab.llm import mixing


def filled(sizes, weights):
    """Reshare by weight, one round after the other."""
    budget, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: budget * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2 * sizes[s]
            budget -= target[s]
        open_ -= above
    return target


def test_targets_and_shares(spark):
    draw = random.Random(1)
    rows = []
    for i in range(600):
        source = draw.choice(["b", "b", "b", "b", "a", "é", "c", None, "", "z"])
        rows.append((i, " w" * draw.randrange(1, 90), source, "x"))
    rows += [(7, None, "a", "x"), (7, "", "empty", "x"), (7, "one two", "a", "x"), (7, "one two", "a", "x"), (None, "x y z", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.shares(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    ordered = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(ordered)}
    target = filled(sizes, weights)
    taken = {}
    for r in mixing.mix(df, keep_rest=True).collect():
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.words
    assert all(abs(taken[s] - target[s]) < 1 for s in sizes)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) > 1.5 * sum(sizes.values()) - len(sizes)
    again = mixing.shares(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken, r.position or 0)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_positions_are_gapless_and_fair(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 3 == 0]) for i in range(300)]
    takes = sorted(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect(), key=lambda r: r.position)
    at, sent = 0, {"a": 0, "b": 0}
    target = {r.source: r.target for r in takes}
    for r in takes:
        assert r.position == at and 0 < r.words <= r.size
        at += r.words
        sent[r.source] += r.words
        assert abs(sent["a"] / target["a"] - sent["b"] / target["b"]) < 0.03
    assert max(r["repeat"] for r in takes) == 1


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    assert [(r.taken, r.target) for r in mixing.shares(df).collect()] == [(0, 0.0)] * 2
    assert mixing.shares(df.limit(0)).count() == 0
