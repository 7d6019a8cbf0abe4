"""Stable pseudonyms: dense ids per field, in order of first appearance.

The dictionary is a table ``(field, key, anon)``.  It can have as many keys as
there are documents, and one key may be in a third of them, so

* keys are aggregated map-side before anything is shuffled,
* ids come from the range-ordered numbering, not from one task per field,
* keys that make up a large part of the occurrences are joined by broadcast (at
  most ``HOT_KEYS`` of them can exist), the others by shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loadlab import schemas
from loadlab.functions import documents
from loadlab.operators.sequence import in_order
from loadlab.session import fits_broadcast, stage

MEMBER_KEYS = "array<struct<field:string,value:string,key:string>>"
HOT_KEYS = 1_000  # a key is hot if it has more than 1/HOT_KEYS of all occurrences


def empty_map(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.PSEUDONYMS)


def occurrences_of(members: DataFrame, order: list[str], patterns: dict[str, str]) -> DataFrame:
    """``order..., place, field, value, key`` for every string to be changed."""
    rows = members.select(*order, F.posexplode("_members").alias("place", "_member")).select(
        *order, "place", F.col("_member.field").alias("field"), F.col("_member.value").alias("value")
    )
    key = documents.matched_key(F.col("field"), F.col("value"), patterns)
    return rows.withColumn("key", key).where(F.col("key").isNotNull())


def occurrences(df: DataFrame, order: list[str], patterns: dict[str, str]) -> DataFrame:
    """Occurrences in typed documents; ``order`` identifies a document and orders them."""
    return occurrences_of(df.select(*order, documents.list_members(df.schema, list(patterns)).alias("_members")), order, patterns)


def json_occurrences(df: DataFrame, order: list[str], patterns: dict[str, str], body: str = "body") -> DataFrame:
    """Occurrences in JSON text."""
    listed = documents.json_members(F.col(body), list(patterns))
    return occurrences_of(df.select(*order, listed.alias("_members")), order, patterns)


def ids_used(known: DataFrame) -> DataFrame:
    """``field, used``: where new ids of a field start, the number of its keys or above the largest id."""
    return known.groupBy("field").agg(F.greatest(F.count("*"), F.max(F.col("anon").try_cast("bigint")) + 1).alias("used"))


def fresh_keys(
    found: DataFrame, order: list[str], known: DataFrame | None = None, used: DataFrame | None = None
) -> DataFrame:
    """``field, key, anon`` of the keys that the known dictionary does not have.

    They count up from the number of known keys of their field, or from above
    the largest known id if those are not dense, in the order in which they
    first occur.  With ``used``, known by other means (:func:`ids_used`, a row per field),
    ``known`` need only hold the keys that occur.
    """
    keys = found.groupBy("field", "key").agg(F.min(F.struct(*order, "place")).alias("_first"))
    if known is not None:
        keys = keys.join(known.select("field", "key"), ["field", "key"], "left_anti")
    numbered = in_order(keys, ["field", "_first"], position="_n")
    # One row per field option.
    starts = numbered.groupBy("field").agg(F.min("_n").alias("_start"))
    if used is None and known is not None:
        used = ids_used(known)
    if used is not None:
        starts = starts.join(used.select("field", F.col("used").alias("_used")), "field", "left")
    else:
        starts = starts.withColumn("_used", F.lit(0))
    return numbered.join(F.broadcast(starts), "field").select(
        "field", "key", (F.col("_n") - F.col("_start") + F.coalesce("_used", F.lit(0))).cast("string").alias("anon")
    )


def extend_map(found: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """The known dictionary plus an id for every new key (:func:`fresh_keys`)."""
    fresh = fresh_keys(found, order, known)
    return fresh if known is None else known.select("field", "key", "anon").unionByName(fresh)


def build_map(
    df: DataFrame, patterns: dict[str, str], order: list[str], known: DataFrame | None = None
) -> DataFrame:
    """Dictionary for typed documents."""
    return extend_map(occurrences(df, order, patterns), order, known)


def keys_per_field(pseudonyms: DataFrame) -> DataFrame:
    """Number of keys each field has so far."""
    return pseudonyms.groupBy("field").agg(F.count("*").alias("keys"))


def small(pseudonyms: DataFrame) -> bool:
    """Whether a dictionary is proven to fit a broadcast."""
    return fits_broadcast(pseudonyms, ["field", "key", "anon"])


def look_up(found: DataFrame, pseudonyms: DataFrame) -> DataFrame:
    """Occurrences with their ``anon``.

    Each key that has more than 1/HOT_KEYS of the occurrences goes through a
    broadcast of at most HOT_KEYS rows, so no shuffle partition has to take it.
    """
    if small(pseudonyms):
        return found.join(F.broadcast(pseudonyms), ["field", "key"])
    counts = stage(found.groupBy("field", "key").agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = (
        counts.where(F.col("_n") * HOT_KEYS > total)
        .join(pseudonyms, ["field", "key"])
        .select("field", "key", F.col("anon").alias("_hot"))
    )
    marked = found.join(F.broadcast(hot), ["field", "key"], "left")
    by_broadcast = marked.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", "anon")
    by_shuffle = marked.where(F.col("_hot").isNull()).drop("_hot").join(pseudonyms, ["field", "key"])
    return by_broadcast.unionByName(by_shuffle)


def _by_order(df: DataFrame, swaps: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_swaps`` of the document with the same ``order``; NULLs are equal."""
    renamed = swaps.select(*[F.col(c).alias(f"_of_{c}") for c in order], "_swaps")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in order])
    return df.join(renamed, same, "left").select(*df.columns, "_swaps")


def _local_swaps(members: Column, patterns: dict[str, str], pseudonyms: DataFrame) -> Column:
    """New values of the strings of one row, with a dictionary proven small.

    The dictionary goes to the executors once, patterns stay in the JVM, and an
    Arrow function looks keys up; no row moves.
    """
    rows = pseudonyms.select("field", "key", "anon").toArrow()
    known = dict(zip(zip(rows["field"].to_pylist(), rows["key"].to_pylist()), rows["anon"].to_pylist()))
    table = pseudonyms.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<string>")
    def anons(keys: pd.Series) -> pd.Series:
        return keys.map(lambda row: [table.value.get((k["field"], k["key"])) for k in row])

    keyed = F.transform(
        members,
        lambda m: F.struct(
            m["field"].alias("field"), m["value"].alias("value"), documents.matched_key(m["field"], m["value"], patterns).alias("key")
        ),
    )
    keyed = F.filter(F.coalesce(keyed, F.array().cast(MEMBER_KEYS)), lambda m: m["key"].isNotNull())
    found = F.transform(
        F.arrays_zip(keyed.alias("m"), anons(keyed).alias("a")),
        lambda z: F.struct(
            z["m"]["field"].alias("field"), z["m"]["value"].alias("value"), F.replace(z["m"]["value"], z["m"]["key"], z["a"]).alias("new")
        ),
    )
    return F.filter(found, lambda s: s["new"].isNotNull())


def _swaps(found: DataFrame, pseudonyms: DataFrame, order: list[str]) -> DataFrame:
    """Per document the new value of each string; a document has as many as it has members."""
    changed = look_up(found, pseudonyms)
    new = F.struct("field", "value", F.replace("value", F.col("key"), F.col("anon")).alias("new"))
    return changed.groupBy(*order).agg(F.collect_set(new).alias("_swaps"))


def rewrite(
    df: DataFrame,
    patterns: dict[str, str],
    pseudonyms: DataFrame,
    order: list[str],
    found: DataFrame | None = None,
    in_jvm: bool = False,
) -> DataFrame:
    """Typed documents with every occurrence of a key in its value replaced.

    A small dictionary is sent along and documents are not shuffled at all.
    Otherwise narrow occurrence rows meet the dictionary and documents are
    joined once by their own key, NULL keys like any other; ``in_jvm`` chooses that
    where a small dictionary would be looked up in Python.
    """
    fields = list(patterns)
    paths = documents.scalar_paths(df.schema, fields)
    is_small = small(pseudonyms)
    if paths is not None and is_small:
        return _rewrite_in_place(df, patterns, pseudonyms, paths)

    def swap(field, value: Column) -> Column:
        name = field if isinstance(field, Column) else F.lit(field)
        hit = F.filter("_swaps", lambda s: (s["field"] == name) & (s["value"] == value))
        return F.coalesce(F.get(hit, F.lit(0))["new"], value)

    if is_small and not in_jvm:
        listed = documents.list_members(df.schema, fields)
        joined = df.withColumn("_swaps", _local_swaps(listed, patterns, pseudonyms))
    else:
        swaps = _swaps(occurrences(df, order, patterns) if found is None else found, pseudonyms, order)
        joined = _by_order(df, swaps, order)
    return joined.withColumns(documents.swap_members(df.schema, fields, swap)).select(*df.columns)


def _rewrite_in_place(df: DataFrame, patterns: dict[str, str], pseudonyms: DataFrame, paths) -> DataFrame:
    joined, lookups = df, {}
    for number, path in enumerate(paths):
        value = F.col(".".join(f"`{part}`" for part in path))
        key, anon = f"_key{number}", f"_anon{number}"
        table = pseudonyms.where(F.col("field") == path[-1]).select(F.col("key").alias(key), F.col("anon").alias(anon))
        joined = joined.join(
            F.broadcast(table), documents.matched_key(F.lit(path[-1]), value, patterns) == F.col(key), "left"
        )
        lookups[path] = F.coalesce(F.replace(value, F.col(key), F.col(anon)), value)
    changes: dict[str, Column] = {}
    for path, new in lookups.items():
        top, *below = path
        if below:
            changes[top] = changes.get(top, F.col(f"`{top}`")).withField(".".join(f"`{p}`" for p in below), new)
        else:
            changes[top] = new
    return joined.withColumns(changes).select(*df.columns)


def json_rewrite(
    df: DataFrame,
    patterns: dict[str, str],
    pseudonyms: DataFrame,
    order: list[str],
    body: str = "body",
    found: DataFrame | None = None,
) -> DataFrame:
    """JSON text with keys replaced, re-encoded with sorted keys where it changed.

    Bodies that do not change stay as they are; numbers are written as they
    were, also those that no number type holds.
    """
    if small(pseudonyms):
        listed = documents.json_members(F.col(body), list(patterns))
        joined = df.withColumn("_swaps", _local_swaps(listed, patterns, pseudonyms))
    else:
        if found is None:
            found = json_occurrences(df, order, patterns, body)
        joined = _by_order(df, _swaps(found, pseudonyms, order), order)
    joined = joined.withColumn("_new", documents.json_swapped(F.col(body), F.col("_swaps")))
    new = F.when(F.size("_swaps") > 0, F.col("_new"))
    return joined.withColumn(body, F.coalesce(new, F.col(body))).select(*df.columns)


def pseudonymise(
    df: DataFrame, patterns: dict[str, str], order: list[str], known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rewritten typed documents and the dictionary they were rewritten with."""
    found = stage(occurrences(df, order, patterns), "occurrences")
    pseudonyms = stage(extend_map(found, order, known), "pseudonyms")
    return rewrite(df, patterns, pseudonyms, order, found), pseudonyms


def json_pseudonymise(
    df: DataFrame, patterns: dict[str, str], order: list[str], known: DataFrame | None = None, body: str = "body"
) -> tuple[DataFrame, DataFrame]:
    """Rewritten JSON rows and the dictionary they were rewritten with."""
    found = stage(json_occurrences(df, order, patterns, body), "occurrences")
    pseudonyms = stage(extend_map(found, order, known), "pseudonyms")
    return json_rewrite(df, patterns, pseudonyms, order, body, found), pseudonyms
