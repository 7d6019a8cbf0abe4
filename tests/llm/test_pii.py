import hashlib
import re

from hypothesis import given, settings, strategies as st

from loadlab.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
                good = all(len(p) <= 3 and int(p) <= 255 for p in parts)
            elif kind == "card":
                good = 16 <= len(digits) <= 19 and pii.luhn(digits)
            else:
                good = kind == "email" or 8 <= len(digits) <= 15
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def own_base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE]


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="a.@-+%0125 ()é\n:/", max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    assert own_base(text) == base(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1111", "x@y.org", "1.2.3.4", "+1 (555) 123-4567", " ", "-", ".", "7", "+", "@", "https://a.b/c", "Account no. 12345678"]), max_size=12))
def test_joined_pieces(parts):
    text = "".join(parts)
    assert own_base(text) == base(text)


def test_more_kinds():
    text = "See https://a.example/x?y=1). IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678; ftp://h"
    kinds = {k: text[s:e] for k, s, e in pii.find(text)}
    assert kinds["url"] == "ftp://h" and ("url", 4, 27) in pii.find(text)
    assert kinds["iban"] == "DE89 3704 0044 0532 0130 00"
    assert kinds["account"] == "12345678"
    assert pii.find("account: none. 3 of 4") == []


def test_long_text_and_code_points():
    text = "é" * 1_000_000 + " ü@ü.de bob@b.org " + "9" * 5000 + ".1.2.3"
    assert own_base(text) == base(text)
    assert pii.find(text)[0] == ("email", 1_000_008, 1_000_017)


def test_rows(spark):
    rows = [(1, "a@b.co", "x"), (1, "a@b.co", "x"), (None, "+12345678901", "y"), (2, None, None), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, [tuple(s) for s in r.spans]) for r in pii.find_personal_data(df).collect())
    assert got == [(0, [("phone", 0, 12)]), (1, [("email", 0, 6)]), (1, [("email", 0, 6)]), (2, []), (3, [])]
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_query_digest(spark, tmp_path):
    from loadlab.llm.queries import QUERIES

    texts = ["x 1.2.3.4 a@b.co http://h/ 4111 1111 1111 1111", None, "+1 555 123 4567"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op4_personal_data"](spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base(text))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base(text)) for x in PATTERNS]
        assert r.spans == pii.as_text(pii.find(text)) and pii.digest(base(text)) == r.base_sha256
