import random

import numpy as np
import corpus_pipeline
from brute import near_duplicates, shingle_set

from loadlab.llm import mixing, packing


def tables(spark, folder):
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(900)]
    bad = ["vilewort", "nastyman", "foulness"]
    text = lambda n: draw.choices(vocabulary, k=n)
    items = [" ".join(text(25)) for _ in range(6)]
    rows, labels, kinds = [], [], {}
    for i in range(500):
        kind = draw.choice(["clean"] * 6 + ["toxic", "copy", "leak"])
        words = text(draw.randrange(30, 120))
        if kind == "toxic":
            words[3:3] = draw.choices(bad, k=4)
        elif kind == "copy" and rows:
            origin = draw.choice(rows)
            if kinds[origin[0]] == "clean":
                words = origin[1].split(" ")
                words[draw.randrange(len(words))] = "changed" if len(words) > 90 else words[0]
        elif kind == "leak":
            words[10:10] = draw.choice(items).upper().split(" ")
        if kind == "copy":
            kind = "clean"
        kinds[i] = kind
        rows.append((i, " ".join(words), "en", draw.choice(["a", "b", "b", "b", None]), 0))
        if i % 2:
            labels.append((i, 1, int(kind == "toxic")))
    rows = [(*r[:4], len(r[1])) for r in rows]
    odd = [(900, None, None, None, None), (901, "", "en", "a", 0), (None, "no key at all here", "en", "b", 18), (902, rows[0][1], "en", "a", 1), (902, rows[0][1], "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + odd, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows + odd, items, kinds


def test_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    rows, items, kinds = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, {}
    for name, work in corpus_pipeline.STAGES:
        out = f"{folder}/{name}"
        work(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        results[name] = docs.collect()
        assert name == "packing" or docs.columns == columns

    ids = [r.doc_id for r in results["toxicity"]]
    wrong = [i for i in kinds if (i in ids) != (kinds[i] != "toxic")]
    assert len(wrong) <= 0.05 * len(kinds) and None in ids and 900 in ids and ids.count(902) == 2

    known = [(r.doc_id, r.text) for r in results["toxicity"] if r.doc_id is not None]
    expected = near_duplicates(known, 5)
    kept = [r.doc_id for r in results["near_duplicates"]]
    assert sorted(x for x in kept if x is not None) == sorted(i for i, (_, c) in expected.items() if c == i)
    assert kept.count(None) == 1 and 902 not in kept

    leaked = {r.doc_id for r in results["near_duplicates"] for i in items if len(shingle_set(i, 5) & shingle_set((r.text or "").lower(), 5)) >= 17}
    clean = [r.doc_id for r in results["decontamination"]]
    assert leaked and set(kept) - leaked == set(clean) and len(clean) == len(set(clean))

    before = {r.doc_id: r for r in results["decontamination"]}
    size = {i: len((r.text or "").split()) for i, r in before.items()}
    taken, of_source = {}, {}
    for r in results["mixing"]:
        assert before[r.doc_id].text.startswith(r.text) and r.n_chars in (len(r.text), before[r.doc_id].n_chars)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    for i in before:
        of_source.setdefault(before[i].source, []).append(i)
        assert taken.get(i, 0) <= 2 * size[i]
    targets = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(before[i].source, size[i]) for i in before], "source string, size long")).collect()}
    for s, members in of_source.items():
        assert abs(sum(taken.get(i, 0) for i in members) - targets[s]) < 1

    with open(packing.VOCABULARY, "rb") as file:
        decode = packing.encoding(file.read()).decode
    texts = []
    for r in results["packing"]:
        tokens = np.frombuffer(r.input_ids, dtype="<u2")
        for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:]):
            texts.append((d, decode(tokens[a : b - 1].tolist())))
    assert sorted(texts, key=str) == sorted(((r.doc_id, r.text) for r in results["mixing"]), key=str)


def test_run(spark, tmp_path):
    tables(spark, str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
