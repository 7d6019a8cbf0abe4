import numpy as np
from brute import component_ids

from loadlab.llm import embeddings


def brute(rows, threshold):
    ids, links, degree = [r[0] for r in rows], [], {}
    for x, (i, v, l) in enumerate(rows):
        for j, w, m in rows[x + 1 :]:
            if l is None or l != m or not v or not w or len(v) != len(w):
                continue
            a, b = (np.array([np.nan if c is None else c for c in u], dtype=float) for u in (v, w))
            if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any():
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links.append((i, j))
                    degree[i], degree[j] = degree.get(i, 0) + 1, degree.get(j, 0) + 1
    found = component_ids(ids, links)
    return {i: (degree.get(i, 0), found[i]) for i in ids}, len(links)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    draw = np.random.default_rng(1)
    rows = []
    for family in range(40):
        base = draw.standard_normal(24)
        for _ in range(draw.integers(1, 60 if family < 3 else 5)):
            v = base + draw.standard_normal(24) * draw.choice([0, 0.05, 0.2])
            rows.append([float(np.float32(x)) for x in v])
    order = draw.permutation(len(rows))
    labels = [int(x) for x in draw.integers(0, 2, len(rows))]
    table = [(int(order[i]), rows[i], labels[i // 20]) for i in range(len(rows))]
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [nan] + [1.0] * 23, [inf] * 24, [1.0, 2.0], [2.0, 4.0], rows[0], [x * 2 for x in rows[0]]]
    table += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(2000, rows[0], None), (2001, rows[0], None)]
    expected, links = brute(table, 0.93)
    df = spark.createDataFrame([(*t, "x") for t in table], "vec_id long, embedding array<float>, label int, k string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_embeddings(df).collect()}
    assert links > 1000
    wrong = {i for i in expected if got[i] != expected[i]}
    assert len(got) == len(expected) and len(wrong) <= 2, [(got[i], expected[i]) for i in wrong][:3]
    assert all(got[1000 + i] == (0, 1000 + i) for i in range(6))


def test_repeated_and_null_keys(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.01], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_embeddings(df).collect())
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False)]
    assert embeddings.near_embeddings(df.limit(0)).count() == 0
