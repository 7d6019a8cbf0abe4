import numpy as np

from loadlab.llm import toxicity


def corpus(n, seed=0):
    draw = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        text = " ".join(draw.choice(words, draw.integers(20, 120)))
        if toxic:
            text += " " + " ".join(draw.choice(["vilewort", "vileworts", "Nastyman!", "nastymen"], 3))
        rows.append((i, text, "l", i))
        if i % 3:
            labels.append((i, int(toxic), "other"))
    return rows, labels


def test_unseen_toxic_documents_are_found(spark):
    rows, labels = corpus(1200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, k long")
    known = spark.createDataFrame(labels + [(None, 1, "x"), (5, None, "y")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs.where("doc_id % 5 <> 0"), known.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if i % 5 == 0]
    wrong = [i for i in held if (got[i] >= 0.5) != (i % 8 == 0)]
    assert len(got) == 1200 and len(wrong) <= len(held) * 0.03
    again = toxicity.train(docs.where("doc_id % 5 <> 0"), known.where("doc_id % 5 <> 0"))
    assert np.array_equal(model.weight, again.weight)


def test_odd_rows(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, k long")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "vilewort " * 300_000)], "doc_id long, text string")
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == 4 and all(0 <= r.score < 0.5 for r in scores if r.doc_id != 2)
    assert max(scores, key=lambda r: r.score).doc_id == 2
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for labels in ([], [(1, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.score(docs, model).first().score < 0.5


def test_risk_ignores_hidden_positives():
    draw = np.random.default_rng(1)
    n = 2000
    toxic = draw.random(n) < 0.3
    positive = toxic & (draw.random(n) < 0.4)
    has = np.where(toxic, draw.random(n) < 0.95, draw.random(n) < 0.05)
    row, column = np.flatnonzero(has), np.zeros(has.sum(), dtype=int)
    prior = toxic[~positive].mean()
    weight, bias = toxicity.fit(positive, row, column, 1, prior, toxicity.Training())
    assert bias < 0 < weight[0] + bias


def test_repeated_keys_do_not_enlarge_the_sample(spark):
    rows = [(7, f"vile text {i % 50}") for i in range(400)] + [(100 + i, f"plain text {i}") for i in range(200)] + [(None, "x")] * 5
    texts = spark.createDataFrame(rows, "k long, text string").where("k is not null")
    toxic = spark.createDataFrame([(7,), (101,)], "k long")
    positive = toxicity._positive(texts, toxic, 60).collect()
    assert len(positive) == 60 and all(r.positive for r in positive)
    for most in (20, 100, 1000):
        drawn = toxicity._drawn(texts, most).collect()
        assert len(drawn) == min(most, 600) and not any(r.positive for r in drawn)
        assert sorted(r.text for r in drawn) == sorted(r.text for r in toxicity._drawn(texts.repartition(3), most).collect())
    labels = spark.createDataFrame([(7, 1), (101, 1), (102, 0), (103, 0)], "doc_id long, toxic int")
    model = toxicity.train(texts.withColumnRenamed("k", "doc_id"), labels, toxicity.Training(most_positive=50, most_unlabelled=100))
    scores = {r.doc_id: r.score for r in toxicity.score(texts.withColumnRenamed("k", "doc_id"), model).collect()}
    assert scores[7] > scores[150]
