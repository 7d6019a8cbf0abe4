import random

import numpy as np
from brute import component_ids, near_duplicates as brute

from loadlab.llm import neardup, setsketch
from loadlab.llm.graph import components


def corpus(seed, families=12, size=12):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for f in range(families):
        base = draw.choices(vocabulary, k=draw.choice([1, 2, 3, 5, 20, 60, 150]))
        for _ in range(draw.choice([1, 2, size])):
            copy = list(base)
            for _ in range(draw.randrange(0, max(1, len(base) // 12) + 1)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(" ".join(copy))
    draw.shuffle(texts)
    return list(enumerate(texts + ["", None, " \t ", texts[0], texts[0].upper(), "é É"]))


def got(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, **options).collect()}


def test_against_all_pairs(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, k string, n int")
    assert got(df, width=2) == brute(docs, 2)


def test_large_family_in_small_chunks(spark):
    docs = corpus(2, families=3, size=90) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(5, families=2, size=60))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for chunk in (4, 16):
        assert got(df, width=2, chunk=chunk) == brute(docs, 2)


def test_pairs_among_strangers(spark):
    """2,000 documents at about 0.5; planted pairs at 0.85 share every bucket with smaller strangers."""
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(600)]
    docs = [(i, draw.sample(vocabulary, 400)) for i in range(2000)]
    for i in range(2000, 2080, 2):
        words = draw.sample(vocabulary, 432)
        docs += [(i, words[:400]), (i + 1, words[32:])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    found = got(df.repartition(4), width=1)
    assert {i: c for i, (_, c) in found.items()} == {i: i - 1 if i > 2000 and i % 2 else i for i, _ in docs}


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (5, "x" * 2_000_000), (6, "b " * 200_000)]
    result = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in result) == [
        (0, 0, 0, True), (0, 2, 0, True), (3, 2, 3, True), (3, 2, 3, True), (5, 1, 5, True), (6, 1, 6, True),
    ]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches():
    draw = np.random.default_rng(4)
    pool = draw.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = np.sort(pool[:2000]), np.sort(pool[600:])
    sketch = setsketch.registers(np.concatenate([a, b, pool]), np.array([0, 2000, 4400, 4400, 7400]))
    assert (setsketch.merge(sketch[0], sketch[1]) == sketch[3]).all() and not sketch[2].any()
    estimate = setsketch.similarity(sketch[:1], sketch[1:2], np.array([2000.0]), np.array([2400.0]))[0]
    assert abs(estimate - 1400 / 3000) < 0.12


def test_components(spark):
    draw = random.Random(9)
    ids = list(range(300))
    links = [(i, i + 1) for i in range(0, 80)] + [(200, i) for i in range(201, 260)] + [(draw.choice(ids), draw.choice(ids)) for _ in range(60)]
    found = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = component_ids(ids, links)
    assert all(found.get(i, i) == expected[i] for i in ids)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
