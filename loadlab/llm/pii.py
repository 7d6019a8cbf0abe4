"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, plus signs, URL schemes,
digits that stand next to a dot or that open a number, and the words that
announce an identifier.  A local parser per anchor then expands to the left and
right of it and checks what it has: boundaries, number of digits, checksums.
Text far from an anchor is never looked at by a parser.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE = KINDS[:4]

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_URL_END = frozenset(" \t\n\v\f\r\"'<>`{}|\\^")
#: Words that announce an account or document number, lower and capital first letter.
CUES = ("account", "acct", "iban", "passport", "ssn", "routing", "konto", "compte", "cuenta")
SCHEMES = ("http://", "https://", "ftp://")


@cache
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    for d in "0123456789":
        automaton.add_word(d, ("digit", 1))
    for scheme in SCHEMES:
        automaton.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            automaton.add_word(form, ("cue", len(form)))
    automaton.make_automaton()
    return automaton


def _run(text: str, at: int, allowed: frozenset) -> int:
    """First place from ``at`` on that is not ``allowed``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == ".":
        stop = _run(text, end + 1, _LABEL)
        if stop == end + 1:
            break
        end, labels = stop, labels + 1
    return (start, end) if labels > 1 else None


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _ip(text: str, at: int) -> tuple[int, int] | None:
    """Four digit runs joined by dots from the digit run at ``at``."""
    end = _run(text, at, _DIGITS)
    for _ in range(3):
        if end >= len(text) or text[end] != ".":
            return None
        stop = _run(text, end + 1, _DIGITS)
        if stop == end + 1:
            return None
        end = stop
    return at, end


def _number(text: str, at: int) -> int:
    """End of the digits from ``at`` on with single blanks or hyphens between them."""
    end, n = _run(text, at, _DIGITS), len(text)
    while end + 1 < n and text[end] in " -" and text[end + 1] in _DIGITS:
        end = _run(text, end + 1, _DIGITS)
    return end


def _phone(text: str, at: int) -> int | None:
    """End of the number after the plus sign at ``at``."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end > at + 3 else None


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """Country, check digits and account, blanks allowed, with the right remainder by 97."""
    if not (at + 4 <= len(text) and text[at] in _UPPER and text[at + 1] in _UPPER and text[at + 2] in _DIGITS):
        return None
    end, kept, best = at, [], None
    while end < len(text) and len(kept) < 34:
        if text[end] in _UPPER or text[end] in _DIGITS:
            kept.append(text[end])
        elif text[end] != " ":
            break
        end += 1
        if 15 <= len(kept) and text[end - 1] != " ":
            code = "".join(kept[4:] + kept[:4])
            if int("".join(str(int(c, 36)) for c in code)) % 97 == 1:
                best = (at, end)
    return best


def _after_cue(text: str, at: int) -> list[tuple[str, int, int]]:
    """What a cue that ends at ``at`` announces: an IBAN, or 6 to 12 digits, within 24 characters of signs and short words."""
    stop = min(len(text), at + 24)
    while at < stop:
        c = text[at]
        if c in _UPPER and (found := _iban(text, at)):
            return [("iban", *found)]
        if c in _DIGITS:
            end = _number(text, at)
            digits = sum(x in _DIGITS for x in text[at:end])
            return [("account", at, end)] if 6 <= digits <= 12 else []
        at += 1
    return []


def find(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind in the order of ``KINDS``, then by start.

    Matches of one kind do not overlap and are the leftmost ones.  A candidate
    that fails its check is dropped, and the search goes on behind it.
    """
    if not text:
        return []
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = phone_end = run_end = other_end = 0
    for last, (what, length) in _automaton().iter(text):
        at = last - length + 1
        if what == "digit":
            if at < run_end:
                continue
            run_end = _run(text, at, _DIGITS)
            if at >= ip_end and run_end < len(text) and text[run_end] == "." and (found := _ip(text, at)):
                ip_end = found[1]
                if all(_byte(p) for p in text[at:ip_end].split(".")):
                    spans["ip"].append(found)
            if at >= card_end:
                card_end = _number(text, at)
                if card_end - at >= 16:
                    digits = "".join(c for c in text[at:card_end] if c in _DIGITS)
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append((at, card_end))
        elif what == "at":
            if found := _email(text, at, email_end):
                email_end = found[1]
                spans["email"].append(found)
        elif what == "plus":
            if at >= phone_end and (end := _phone(text, at)):
                phone_end = end
                if 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    spans["phone"].append((at, end))
        elif what == "scheme":
            if at >= other_end:
                end = last + 1
                while end < len(text) and text[end] not in _URL_END:
                    end += 1
                while end > last + 1 and text[end - 1] in ".,;:!?)":
                    end -= 1
                if end > last + 1:
                    spans["url"].append((at, end))
                    other_end = end
        else:
            for kind, start, end in _after_cue(text, last + 1):
                if not spans[kind] or start >= spans[kind][-1][1]:
                    spans[kind].append((start, end))
    return [(kind, s, e) for kind in KINDS for s, e in spans[kind]]


def find_personal_data(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans array<struct<kind, start, end>>`` of each document, in code points.

    One pass over the texts, no shuffle.  NULL and empty texts have no spans;
    rows with a NULL or repeated key are kept as they are; other columns,
    whatever their names, are not read.
    """
    source = documents.select(documents[key].alias("k"), documents[text].alias("t"))
    kind = source.schema["k"].dataType
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py())] for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found, spans)], names=[key, "spans"])

    return source.mapInArrow(
        scan, f"`{key}` {kind.simpleString()}, spans array<struct<kind: string, start: int, end: int>>"
    )


def as_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(as_text(spans).encode()).hexdigest()
