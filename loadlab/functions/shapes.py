"""The common shape of JSON bodies, as a struct type that keeps their text.

Spark finds the shape from the bodies as variants.  Members come in the order in which a body writes
them, so that most bodies can be had back letter by letter from the typed document.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _struct_type(shape: str) -> T.DataType:
    """A variant schema as a type: what is of several kinds, or never there, is read as a string."""
    parts = re.split(r"(`(?:[^`]|``)*`)", shape)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\bOBJECT\b", "STRUCT", re.sub(r"\b(VARIANT|VOID)\b", "STRING", parts[i]))
    return T._parse_datatype_string("".join(parts))


def _as_written(kind: T.DataType, sample) -> T.DataType:
    """``kind`` with members in the order of ``sample``, further ones behind."""
    if isinstance(kind, T.ArrayType):
        items = [s for s in sample if isinstance(s, (dict, list))] if isinstance(sample, list) else []
        return T.ArrayType(_as_written(kind.elementType, items[0] if items else None))
    if not isinstance(kind, T.StructType):
        return kind
    known = sample if isinstance(sample, dict) else {}
    places = {name: i for i, name in enumerate(known)}
    fields = sorted(kind.fields, key=lambda f: (places.get(f.name, len(places)), f.name))
    return T.StructType([T.StructField(f.name, _as_written(f.dataType, known.get(f.name))) for f in fields])


def _empty(kind: T.DataType) -> bool:
    """Whether an object without members is part of it: no struct can tell what it was."""
    if isinstance(kind, T.ArrayType):
        return _empty(kind.elementType)
    return isinstance(kind, T.StructType) and (not kind.fields or any(_empty(f.dataType) for f in kind.fields))


def common_shape(df: DataFrame, body: str = "body") -> T.StructType | None:
    """The shape of the JSON objects in ``body``: one pass in the JVM, one row.  None if there is none to use."""
    value = F.try_parse_json(F.col(body))
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    objects = df.where(is_object)
    sample = F.min_by(F.col(body), F.struct(-F.length(body), body))
    shape, longest = objects.agg(F.schema_of_variant_agg(value), sample).first()
    if longest is None:
        return None
    kind = _as_written(_struct_type(shape), json.loads(longest))
    if not isinstance(kind, T.StructType) or _empty(kind):
        return None
    names = [f.name.lower() for f in kind.fields]
    return kind if len(set(names)) == len(names) else None


def in_name_order(value: Column, kind: T.DataType) -> Column:
    """A typed document with members sorted by name at every level."""
    if isinstance(kind, T.ArrayType) and _has_struct(kind):
        return F.transform(value, lambda item: in_name_order(item, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[in_name_order(value[f.name], f.dataType).alias(f.name) for f in fields]))
    return value


def _has_struct(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) or (isinstance(kind, T.ArrayType) and _has_struct(kind.elementType))
