"""String members of documents, found by field name at every level.

Typed documents (Spark structs) are walked once on the driver along their schema
and become plain column expressions.  JSON text of unknown shape goes through two
small Arrow functions that only list and swap strings; patterns, ids and joins
stay in Spark.

A member counts if it is a string, its name is a wanted field, and it sits in an
object that is reached through objects and through objects directly in arrays.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession, functions as F, types as T

from loadlab import fixed_values as fixed

MEMBER = "array<struct<field:string,value:string>>"


WHOLE_VALUE = r"(?s)\A(.*)\z"


def _unnamed_groups(pattern: str) -> str:
    """``(?P<name>`` as a plain group, outside escapes and character classes: groups count by number here."""
    out, at, in_class, quoted = [], 0, False, False
    while at < len(pattern):
        if quoted or pattern.startswith("\\Q", at):
            end = pattern.find("\\E", at)
            stop = len(pattern) if end < 0 else end + 2
            out.append(pattern[at:stop])
            at = stop
            continue
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if c in "[]":
            in_class = c == "["
        elif not in_class and pattern.startswith("(?P<", at) and ">" in pattern[at:]:
            out.append("(")
            at = pattern.index(">", at) + 1
            continue
        out.append(c)
        at += 1
    return "".join(out)


def field_patterns(options: list[str]) -> dict[str, str]:
    """``field::pattern`` options; the pattern's first group is what gets replaced.

    A bare field name means the whole value, line breaks included.  The last
    option for a field counts.  Patterns are checked by the engine that runs
    them, so a session has to be there.
    """
    engine = SparkSession.active()._jvm.java.util.regex.Pattern
    patterns = {}
    for option in options:
        field, *rest = option.split(fixed.FIELD_PATTERN_SEPARATOR)
        pattern = _unnamed_groups(rest[0]) if rest else WHOLE_VALUE
        try:
            groups = engine.compile(pattern).matcher("").groupCount()
        except (IllegalArgumentException, Py4JJavaError) as error:
            raise ValueError(f"invalid pattern for {field!r}: {rest[0]!r}") from error
        if groups < 1:
            raise ValueError(f"pattern for {field!r} needs a group: {rest[0]!r}")
        patterns[field] = pattern
    return patterns


def matched_key(field: Column, value: Column, patterns: dict[str, str]) -> Column:
    """The part of ``value`` to be replaced; NULL if there is none."""
    key = F.lit(None).cast("string")
    for name, pattern in patterns.items():
        key = F.when(field == name, F.regexp_extract(value, pattern, 1)).otherwise(key)
    return F.nullif(key, F.lit(""))


# --- typed documents ---------------------------------------------------------


def scalar_paths(schema: T.StructType, fields, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]] | None:
    """Paths of the wanted strings, or None if some lie in arrays or maps."""
    paths = []
    for member in schema.fields:
        path, kind = (*prefix, member.name), member.dataType
        if isinstance(kind, T.StringType) and member.name in fields:
            paths.append(path)
        elif isinstance(kind, T.StructType):
            below = scalar_paths(kind, fields, path)
            if below is None:
                return None
            paths += below
        elif isinstance(kind, (T.ArrayType, T.MapType)) and _holds(kind, fields):
            return None
    return paths


def _holds(kind: T.DataType, fields) -> bool:
    if isinstance(kind, T.StructType):
        return any(
            (isinstance(m.dataType, T.StringType) and m.name in fields) or _holds(m.dataType, fields)
            for m in kind.fields
        )
    if isinstance(kind, T.ArrayType):
        return isinstance(kind.elementType, T.StructType) and _holds(kind.elementType, fields)
    if isinstance(kind, T.MapType):
        return isinstance(kind.valueType, T.StringType) or _holds(kind.valueType, fields)
    return False


def _listed(name: str | None, value: Column, kind: T.DataType, fields) -> list[Column]:
    """Array columns of ``(field, value)`` below one member."""
    if isinstance(kind, T.StringType) and name in fields:
        return [F.array(F.struct(F.lit(name).alias("field"), value.alias("value")))]
    if not _holds(kind, fields):
        return []
    if isinstance(kind, T.StructType):
        return [c for m in kind.fields for c in _listed(m.name, value[m.name], m.dataType, fields)]
    if isinstance(kind, T.ArrayType):
        inner = lambda item: F.concat(*_listed(None, item, kind.elementType, fields))
        return [F.flatten(F.transform(value, inner))]
    if isinstance(kind.valueType, T.StringType):
        entries = F.filter(F.map_entries(value), lambda e: e["key"].isin(*fields))
        return [F.transform(entries, lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))]
    inner = lambda item: F.concat(*_listed(None, item, kind.valueType, fields))
    return [F.flatten(F.transform(F.map_values(value), inner))]


def list_members(schema: T.StructType, fields) -> Column:
    """All wanted strings of a row, in schema order."""
    empty = F.array().cast(MEMBER)
    lists = [c for m in schema.fields for c in _listed(m.name, F.col(f"`{m.name}`"), m.dataType, fields)]
    return F.concat(empty, *[F.coalesce(c, empty) for c in lists])


Swap = Callable[[str | Column, Column], Column]


def _swapped(name: str | None, value: Column, kind: T.DataType, fields, swap: Swap) -> Column:
    if isinstance(kind, T.StringType) and name in fields:
        return swap(name, value)
    if not _holds(kind, fields):
        return value
    if isinstance(kind, T.StructType):
        for m in kind.fields:
            changed = isinstance(m.dataType, T.StringType) and m.name in fields
            if changed or _holds(m.dataType, fields):
                value = value.withField(f"`{m.name}`", _swapped(m.name, value[m.name], m.dataType, fields, swap))
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _swapped(None, item, kind.elementType, fields, swap))
    if isinstance(kind.valueType, T.StringType):
        return F.transform_values(value, lambda k, v: F.when(k.isin(*fields), swap(k, v)).otherwise(v))
    return F.transform_values(value, lambda k, v: _swapped(None, v, kind.valueType, fields, swap))


def swap_members(schema: T.StructType, fields, swap: Swap) -> dict[str, Column]:
    """Columns that change, with every wanted string passed through ``swap(field, value)``."""
    changed = {}
    for m in schema.fields:
        if (isinstance(m.dataType, T.StringType) and m.name in fields) or _holds(m.dataType, fields):
            changed[m.name] = _swapped(m.name, F.col(f"`{m.name}`"), m.dataType, fields, swap)
    return changed


# --- JSON text of unknown shape ----------------------------------------------


class _Number:
    """A number as it is written: doubles do not hold every JSON number."""

    def __init__(self, text: str):
        self.text = text


def _decoded(text: str):
    return json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_Number)


def _encoded(node) -> str:
    mark = uuid.uuid4().hex
    text = json.dumps(
        node, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=lambda number: f"{mark}{number.text}"
    )
    return re.sub(f'"{mark}([^"]*)"', r"\1", text)


def _visit(node, fields, at_string) -> None:
    """Call ``at_string(object, name)`` for every wanted string below ``node``."""
    for name, value in node.items():
        if isinstance(value, dict):
            _visit(value, fields, at_string)
        elif isinstance(value, list):
            for item in value:
                if isinstance(item, dict):
                    _visit(item, fields, at_string)
        elif isinstance(value, str) and name in fields:
            at_string(node, name)


def json_members(body: Column, fields: list[str]) -> Column:
    """``(field, value)`` of every wanted string in a JSON object.

    Only bodies in which a wanted name can occur leave the JVM: those that
    hold it in quotes, or an escape that might spell it.
    """
    wanted = frozenset(fields)

    @F.pandas_udf(MEMBER)
    def listed(bodies: pd.Series) -> pd.Series:
        def members(text):
            found = []
            node = _decoded(text) if text else None
            if isinstance(node, dict):
                _visit(node, wanted, lambda at, name: found.append({"field": name, "value": at[name]}))
            return found

        return bodies.map(members)

    possible = F.contains(body, F.lit("\\u"))
    for name in fields:
        possible = possible | F.contains(body, F.lit(json.dumps(name, ensure_ascii=False)))
    return listed(F.when(possible, body))


def json_swapped(body: Column, swaps: Column) -> Column:
    """The JSON object with strings replaced; ``swaps`` is ``array<struct<field, value, new>>``."""

    @F.pandas_udf("string")
    def swapped(bodies: pd.Series, pairs: pd.Series) -> pd.Series:
        def one(text, pair):
            if pair is None or not len(pair):
                return text
            new = {(p["field"], p["value"]): p["new"] for p in pair}
            node = _decoded(text)

            def swap(at, name):
                at[name] = new.get((name, at[name]), at[name])

            _visit(node, {field for field, _ in new}, swap)
            return _encoded(node)

        return pd.Series([one(text, pair) for text, pair in zip(bodies, pairs)], dtype=object)

    return swapped(body, swaps)
