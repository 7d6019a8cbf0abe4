import random
import re

import numpy as np

from loadlab.llm import suffixes


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())


def covered(docs, least):
    """Words of each document in sequences of ``least`` words that are found more than once."""
    places = {}
    for row, (_, text) in enumerate(docs):
        w = words(text)
        for i in range(len(w) - least + 1):
            places.setdefault(tuple(w[i : i + least]), []).append((row, i))
    out = {}
    for found in places.values():
        if len(found) > 1:
            for row, i in found:
                out.setdefault(docs[row][0], set()).update(range(i, i + least))
    return out


def got(df, least):
    rows = suffixes.repeated_passages(df, least).collect()
    out = {}
    for r in rows:
        assert r.n_words == r.end_word - r.start_word >= least
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out, rows


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(5000)]
    passages = [draw.choices(vocabulary, k=k) for k in (49, 50, 51, 60, 90, 300)]
    docs = []
    for d in range(120):
        parts = draw.choices(vocabulary, k=draw.randrange(0, 200))
        if d % 3 == 0:
            passage = draw.choice(passages)
            at = draw.randrange(len(parts) + 1)
            parts[at:at] = passage
        docs.append((d, ", ".join(parts)))
    return docs + [(300, None), (301, ""), (302, docs[0][1].upper()), (303, "la " * 3000)]


def test_against_all_sequences(spark):
    docs = corpus(6)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, k string, pos int")
    found, rows = got(df.repartition(5), 50)
    assert found == covered(docs, 50)
    # Of every passage a copy stays.
    texts = dict(docs)
    dropped, kept = set(), set()
    for r in rows:
        sequences = {tuple(words(texts[r.doc_id])[i : i + 50]) for i in range(r.start_word, r.end_word - 49)}
        (dropped if r.earlier else kept).update(sequences)
    assert any(r.earlier for r in rows) and len(dropped - kept) <= 0.02 * len(dropped | kept)


def test_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(70))
    rows = [(1, text), (1, text), (None, text), (2, "short"), (3, None)]
    found, _ = got(spark.createDataFrame(rows, "doc_id long, text string"), 50)
    assert found == {1: set(range(70))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffixes.repeated_passages(df.limit(0)).count() == 0
    assert suffixes.repeated_passages(df.where("doc_id = 2")).count() == 0


def test_minimisers():
    draw = np.random.default_rng(8)
    gram = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    gram[100:160] = gram[100]
    row = np.repeat([0, 1, 2], [250, 30, 220])
    expected = set()
    for i in range(500 - 40):
        if row[i] == row[i + 40]:
            window = gram[i : i + 41] >> np.uint64(24)
            expected.add(i + int(window.argmin()))
    assert suffixes.minimisers(gram, row, 41).tolist() == sorted(expected)
