import numpy as np
from hypothesis import given, settings, strategies as st

from loadlab.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_best_fit_decreasing(lengths):
    where, rows = packing.best_fit_decreasing(np.array(lengths, dtype=int), 30)
    free = []  # the plain search
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free[free.index(min(fits))] -= lengths[i]
        else:
            free.append(30 - lengths[i])
    used = np.bincount(where, weights=lengths, minlength=rows) if rows else np.zeros(0)
    assert rows == len(free) and sorted(30 - used) == sorted(free)


def test_texts_come_back(spark):
    texts = [None, "", "One two three.", "Wörter, überall! " * 40, "x" * 3000, "<|endoftext|> is text", "One two three."]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no key", "y")], "doc_id long, text string, input_ids string")
    with open(packing.VOCABULARY, "rb") as file:
        decode = packing.encoding(file.read()).decode
    for length, block in ((64, 1 << 21), (64, 100), (4096, 1 << 21)):
        packs = packing.pack(docs, length=length, block_tokens=block).collect()
        found = {}
        for r in packs:
            ids = np.frombuffer(r.input_ids, dtype="<u2")
            assert len(ids) == length and r.cu_seqlens[0] == 0 and list(r.cu_seqlens[:-1]) == list(r.position_resets)
            assert (ids[r.cu_seqlens[-1] :] == packing.END_OF_TEXT).all()
            for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
                found.setdefault(d, []).append((o, ids[a:b]))
        assert len({r.pack_id for r in packs}) == len(packs)
        for d, parts in found.items():
            parts.sort(key=lambda p: p[0])
            assert [p[0] for p in parts] == list(np.cumsum([0, *[len(p[1]) for p in parts[:-1]]]))
            ids = np.concatenate([p[1] for p in parts]).tolist()
            assert ids.pop() == packing.END_OF_TEXT
            assert decode(ids) == ("no key" if d is None else texts[d] or "")
        assert len(found) == len(texts) + 1
    listed = packing.segments(packing.pack(docs, length=64))
    assert listed.groupBy().sum("length").first()[0] == sum(r.cu_seqlens[-1] for r in packing.pack(docs, length=64).collect())


def test_no_document(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_runs_of_blanks(spark):
    with open(packing.VOCABULARY, "rb") as file:
        encoder = packing.encoding(file.read())
    plain = lambda t: encoder.encode(t, disallowed_special=())
    for blank in (" ", "\n", "\t", " \n", "　", "\x85 ", "\r\n", " "):
        run = blank * 5000
        for text in (run, "a" + run, run + "b", "a" + run + "b" + run + "\n1", "a" + run + "'s", run[:4096] + "!", "a" + run[:4095] + "b", run + "\x1c" + run):
            assert packing.encode(encoder, text).tolist() == plain(text)
    # Longer than the splitting pattern takes.
    texts = ["a" + blank * 1_000_000 + end for blank in (" ", "\n", "　") for end in ("", "b")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in packing.segments(packing.pack(docs, length=1 << 16)).collect():
        ids = np.frombuffer(r.input_ids, dtype="<u2")[r.start : r.start + r.length]
        found.setdefault(r.doc_id, []).append((r.doc_offset, ids))
    for i, text in enumerate(texts):
        ids = np.concatenate([p for _, p in sorted(found[i], key=lambda p: p[0])]).tolist()
        assert encoder.decode(ids[:-1]) == text
