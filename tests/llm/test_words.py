import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from loadlab.llm import words

TEXT = st.one_of(st.none(), st.text(alphabet="aAbÉ \t\n.- ", max_size=30))


def plain(text, signs):
    out, word = [], b""
    for byte in (text or "").encode() + b" ":
        if byte == 0x20 or 9 <= byte <= 13 or signs and byte < 128 and not chr(byte).isalnum():
            if word:
                out.append(word)
            word = b""
        else:
            word += bytes([byte])
    return out


def check(texts, signs, at=0, stop=None, ascii_only=False):
    column = words.lowered(pa.array(texts, pa.string())[at:stop], ascii_only)
    got = words.split_words(column, signs)
    hashes = {}
    for i, text in enumerate(texts[at:stop]):
        low = (text or "").lower() if not ascii_only else "".join(c.lower() if c.isascii() else c for c in text or "")
        expected = plain(low, signs)
        mine = range(got.first[i], got.first[i + 1])
        assert [got.data[got.start[j] : got.end[j]].tobytes() for j in mine] == expected
        for j, word in zip(mine, expected):
            assert hashes.setdefault(word, got.hash[j]) == got.hash[j]
    assert len(set(map(int, hashes.values()))) == len(hashes)
    return got


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=12), st.booleans(), st.integers(0, 5), st.booleans())
def test_words(texts, signs, at, ascii_only):
    check(texts, signs, at, ascii_only=ascii_only)


def test_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 64)
    draw = random.Random(2)
    texts = ["".join(draw.choices("abc   é", k=draw.randrange(400))) for _ in range(60)] + ["x" * 9000, "y" * 200 + " z", None]
    for at in (0, 7):
        check(texts, False, at)


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab c"] * 50 + [None, "", "Xé " * 2000] + ["y z"] * 20)], names=["t"])
    parts = list(words.slices(batch, "t", 40))
    assert sum(p.num_rows for p in parts) == batch.num_rows and len(parts) > 5
    for part in parts:
        for ascii_only in (True, False):
            check(part.column("t").to_pylist(), False, ascii_only=ascii_only)
            got = words.split_words(words.lowered(part.column("t"), ascii_only))
            assert np.diff(got.first).tolist() == [len((t or "").split()) for t in part.column("t").to_pylist()]


def test_shingles():
    got = words.split_words(words.lowered(pa.array(["a b c d", "a", "", None, "c d a b", "b c"])))
    hash, row = words.shingles(got.hash, got.first, 2)
    assert row.tolist() == [0, 0, 0, 1, 4, 4, 4, 5]
    assert hash[0] == hash[6] and hash[2] == hash[4] and hash[1] == hash[7] and len(set(hash.tolist())) == 5
    sets, first = words.distinct_per_row(hash, row, 6)
    assert first.tolist() == [0, 3, 4, 4, 4, 7, 8] and sets[:3].tolist() == sorted(hash[:3].tolist())
    assert words.shingles(got.hash, got.first, 2, whole_if_short=False)[1].tolist() == [0, 0, 0, 4, 4, 4, 5]
