import random
import re

from loadlab.llm import containment


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())


def brute(docs, items):
    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v:
                continue
            k = min(5, len(v))
            own = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)}
            there = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)}
            both = len(own & there)
            if 5 * both >= 4 * len(own):
                out.append((d, i, len(own), both))
    return sorted(out, key=str)


def test_against_all_pairs(spark):
    draw = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(60)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 3, 4, 5, 6, 9, 30, 80, 200])))) for i in range(60)]
    items += [(60, None), (61, ""), (62, "!!"), (3, items[3][1]), (None, items[8][1].upper())]
    docs = []
    for d in range(150):
        parts = draw.choices(vocabulary, k=draw.randrange(0, 300))
        for _ in range(draw.randrange(3)):
            item = (draw.choice(items)[1] or "").split()
            for _ in range(draw.randrange(4)):
                if item:
                    item[draw.randrange(len(item))] = "changed"
            at = draw.randrange(len(parts) + 1)
            parts[at:at] = item
        docs.append((d, ", ".join(parts)))
    docs += [(7, docs[7][1]), (200, None), (201, ""), (202, " ".join(vocabulary) * 3000 + " " + items[9][1])]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, shared int")
    queries = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    expected = brute(docs, items)
    assert len(expected) > 100
    for block in (8 << 20, 3000):
        got = containment.contained(df, queries, block_bytes=block).collect()
        assert sorted([(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got], key=str) == expected
        assert all(r.containment == r.shared / r.item_shingles for r in got)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert containment.contained(df.limit(0), items).count() == 0
    assert containment.contained(df, items.limit(0)).count() == 0
    assert containment.contained(df, items).count() == 1
