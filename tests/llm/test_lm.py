import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest

from loadlab.llm import lm
from loadlab.session import shared_dir


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())


def model(texts):
    word, pair = Counter(), Counter()
    for t in texts:
        w = words(t)
        word.update(w)
        pair.update(zip(w, w[1:]))
    return word, pair


def loss(counts, scale, w):
    """Mean loss by plain dictionaries; a first word has no history."""
    word, pair = counts
    s = lm.Smoothing()
    size = 1 << lm.WORD_BITS
    total = sum(word.values()) * scale + s.words * size
    out = 0.0
    for i, x in enumerate(w):
        alone = (word[x] * scale + s.words) / total
        seen = word[w[i - 1]] * scale if i else 0.0
        both = pair[w[i - 1], x] * scale if i else 0.0
        out -= math.log((both + s.pairs * alone) / (seen + s.pairs))
    return out / len(w)


def test_against_dictionaries(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(50)]
    docs = [(i, ", ".join(draw.choices(vocabulary, k=draw.randrange(1, 60)))) for i in range(80)]
    docs += [(80, None), (81, ""), (82, "!?"), (None, "w1 w2"), (3, docs[3][1]), (83, "unheard of")]
    target = [(" ".join(draw.choices(vocabulary[:10], k=30)),) for _ in range(40)] + [(None,)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    got = lm.cross_entropy_difference(df.repartition(3), spark.createDataFrame(target, "text string")).collect()
    assert len(got) == len(docs)
    t, b = model(x[0] for x in target), model(x[1] for x in docs)
    scale = sum(t[0].values()) / sum(b[0].values())
    texts = dict(docs)
    for r in got:
        w = words(texts[r.doc_id])
        assert r.n_tokens == len(w)
        if not w:
            assert r.score is None and r.target_loss is None
            continue
        assert abs(r.target_loss - loss(t, 1.0, w)) < 1e-4
        assert abs(r.background_loss - loss(b, scale, w)) < 1e-4
        assert abs(r.score - (r.target_loss - r.background_loss)) < 1e-9


def test_like_the_target_scores_lower(spark):
    draw = random.Random(5)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    docs = [(i, " ".join(draw.choices(a if i % 4 == 0 else b, k=50))) for i in range(200)]
    target = [(" ".join(draw.choices(a, k=50)),) for _ in range(30)]
    got = lm.cross_entropy_difference(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "text string"))
    scores = {r.doc_id: r.score for r in got.collect()}
    assert max(s for i, s in scores.items() if i % 4 == 0) < min(s for i, s in scores.items() if i % 4)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.cross_entropy_difference(df.limit(0), df).count() == 0
    assert lm.cross_entropy_difference(df, df.limit(0)).first().n_tokens == 2


def test_more_pairs_than_a_fixed_table(spark, monkeypatch):
    """Some 2.4 million different pairs, scored as by plain dictionaries, whether all are sent or most are joined."""
    draw = random.Random(8)
    new = lambda n: [f"w{draw.randrange(200_000)}" for _ in range(n)]
    docs = [(i, " ".join(new(2_000))) for i in range(1_000)] + [(1_000, None), (None, "w1 w2")]
    target = [(" ".join(new(2_000)),) for _ in range(200)] + [(docs[7][1],)]
    t, b = model(x[0] for x in target), model(x[1] for x in docs)
    scale = sum(t[0].values()) / sum(b[0].values())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    texts = dict(docs)
    for head in (1 << 20, 1 << 22):
        monkeypatch.setattr(lm, "HEAD", head, raising=False)
        got = lm.cross_entropy_difference(df, spark.createDataFrame(target, "text string")).collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, texts))
        for r in got:
            w = words(texts[r.doc_id])
            assert r.n_tokens == len(w)
            if w:
                assert abs(r.target_loss - loss(t, 1.0, w)) < 1e-6 and abs(r.background_loss - loss(b, scale, w)) < 1e-6
            else:
                assert r.score is None


def test_other_background(spark):
    docs = [(1, "a b c"), (2, "x y z"), (3, "a b x")]
    target, background = [("a b c a b",)], [("a b x a",), ("c c",)]
    got = lm.cross_entropy_difference(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(target, "text string"),
        spark.createDataFrame(background, "text string"),
    ).collect()
    t, b = model(x[0] for x in target), model(x[0] for x in background)
    for r in got:
        w = words(dict(docs)[r.doc_id])
        assert abs(r.target_loss - loss(t, 1.0, w)) < 1e-6 and abs(r.background_loss - loss(b, 5 / 6, w)) < 1e-6


@pytest.mark.parametrize("head, often", [(0, 0), (1, 30), (12, 0), (12, 8), (1 << 19, 0)])
def test_what_is_sent_changes_nothing(spark, monkeypatch, head, often):
    """Words and pairs that are not sent meet in the shuffle, of the documents as the background and of another one."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    new = lambda n: " ".join(draw.choices(vocabulary, weights, k=n))
    docs = [(f"d{i}", new(draw.randrange(0, 50))) for i in range(60)] + [("none", None), (None, "w1 w2 once w1 w2"), ("d3", "once"), ("x", "w59 w59 w59")]
    target, other = [(new(20),) for _ in range(30)] + [(None,), ("w59 w58",)], [(new(25),) for _ in range(20)] + [("w59",)]
    monkeypatch.setattr(lm, "HEAD", head, raising=False)
    monkeypatch.setattr(lm, "PAIRS", often, raising=False)
    monkeypatch.setattr(lm, "_OFTEN", 1, raising=False)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "i long, doc_id string, text string").repartition(3)
    for background in (None, other):
        t, b = model(x[0] for x in target), model(x[0] for x in background) if background else model(x[1] for x in docs)
        scale = sum(t[0].values()) / sum(b[0].values())
        args = [spark.createDataFrame(x, "text string") for x in (target, background) if x]
        got = lm.cross_entropy_difference(df, *args, key="i").collect()
        assert sorted(r.i for r in got) == list(range(len(docs)))
        for r in got:
            w = words(docs[r.i][1])
            assert r.n_tokens == len(w)
            if w:
                assert abs(r.target_loss - loss(t, 1.0, w)) < 1e-9 and abs(r.background_loss - loss(b, scale, w)) < 1e-9
            else:
                assert r.target_loss is None and r.score is None


def test_no_table_of_pairs_is_written(spark):
    """Nearly all pairs are found once: what is staged holds words and frequent pairs, a small part of the texts."""
    draw = random.Random(12)
    docs = [(i, " ".join(f"w{draw.randrange(3_000)}" for _ in range(1_000))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    staged = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    before = staged()
    assert lm.cross_entropy_difference(df, df.limit(20)).count() == 300
    assert staged() - before < 0.2 * sum(len(d[1]) for d in docs)
