"""Pseudonyms in JSON bodies whose shapes agree, without leaving the JVM.

A body that comes back letter by letter from the typed document of the common shape is rewritten as a struct.  All
others (explicit nulls, a member of another kind, other spelling of numbers or blanks, another order of members) are
rewritten as JSON text of unknown shape, row by row; both share one dictionary and give what that way alone gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from loadlab.functions import documents, shapes
from loadlab.operators import pseudonyms
from loadlab.session import stage


def _split(df: DataFrame, shape: T.StructType, body: str) -> DataFrame:
    """``df`` with either ``_doc`` or ``body``: what a typed document gives back needs no text."""
    # Evaluated once per row, by a generator, not in each column that uses it.
    parsed = df.select("*", F.inline(F.array(F.struct(F.from_json(body, shape).alias("_parsed")))))
    # Escapes may be spelled in several ways.
    same = F.coalesce((F.to_json("_parsed") == F.col(body)) & ~F.contains(F.col(body), F.lit("\\u")), F.lit(False))
    kept = parsed.select("*", F.inline(F.array(F.struct(same.alias("_same")))))
    doc = F.when(F.col("_same"), F.col("_parsed")).alias("_doc")
    text = F.when(~F.col("_same"), F.col(body)).alias(body)
    return kept.select(*[text if c == body else F.col(c) for c in df.columns], "_same", doc)


def _rewritten(typed: DataFrame, patterns: dict[str, str], names: DataFrame, order: list[str], found: DataFrame, body: str) -> DataFrame:
    shape = typed.schema["_doc"].dataType
    others = [c for c in typed.columns if c not in ("_doc", "_same", body)]
    # Only members of the document are rewritten, whatever the columns beside it are called.
    aside = {c: f"_column{i}" for i, c in enumerate(others)}
    plain = typed.select(*[F.col(f"`{c}`").alias(a) for c, a in aside.items()], F.to_json("_doc").alias("_text"), "_doc")
    of = [aside[c] for c in order]
    occurring = found.select(*[F.col(f"`{c}`").alias(aside[c]) for c in order], "place", "field", "value", "key")
    new = pseudonyms.rewrite(plain, patterns, names, of, occurring, in_jvm=True)
    changed = F.to_json(shapes.in_name_order(F.col("_doc"), shape))
    text = F.when(F.to_json("_doc") == F.col("_text"), F.col("_text")).otherwise(changed)
    return new.select(*[F.col(a).alias(c) for c, a in aside.items()], text.alias(body))


def pseudonymise_shaped(
    df: DataFrame, patterns: dict[str, str], order: list[str], known: DataFrame | None = None, body: str = "body"
) -> tuple[DataFrame, DataFrame]:
    """Rewritten JSON rows and the dictionary, as :func:`loadlab.operators.pseudonyms.json_pseudonymise` gives them.

    Bodies that do not change stay as they are; changed ones have sorted members.
    """
    shape = shapes.common_shape(df, body)
    if shape is None:
        return pseudonyms.json_pseudonymise(df, patterns, order, known, body)
    split = stage(_split(df, shape, body), "shaped")
    typed, others = split.where("_same"), split.where("not _same").drop("_same", "_doc")
    listed = documents.list_members(T.StructType([split.schema["_doc"]]), list(patterns))
    of_typed = stage(pseudonyms.occurrences_of(typed.select(*order, listed.alias("_members")), order, patterns), "occurrences")
    # All of one shape: nothing is left for the other way.
    mixed = not others.isEmpty()
    found = of_typed
    if mixed:
        of_others = stage(pseudonyms.json_occurrences(others, order, patterns, body), "occurrences")
        found = of_typed.unionByName(of_others)
    names = stage(pseudonyms.extend_map(found, order, known), "pseudonyms")
    rows = _rewritten(typed, patterns, names, order, of_typed, body).select(*df.columns)
    if mixed:
        rows = rows.unionByName(pseudonyms.json_rewrite(others, patterns, names, order, body, of_others).select(*df.columns))
    return rows, names
