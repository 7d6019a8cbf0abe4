"""Readers: files of the exchanged formats as DataFrames."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlab import schemas
from loadlab.operators import nodes
from loadlab.operators.sequence import BLOCK_ROWS, carry_forward, in_order
from loadlab.session import stage

# Columns that identify a text line and sort lines in input order.
LINE_ORDER = ["file", "block", "line"]


def _without_return(line: Column) -> Column:
    """A line ends with a newline and one optional carriage return before it."""
    return F.when(F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, line, value``: text lines with their place in the input.

    Files may be split; blocks of a file and lines of a block keep their order.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        _without_return(F.col("value")).alias("value"),
    )


def read_slowlog(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Slow-log lines in input order."""
    return read_lines(spark, path)


def stream_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of files as they arrive: ``value``."""
    text = spark.readStream.options(**options).option("lineSep", "\n").text(path)
    return text.select(_without_return(F.col("value")).alias("value"))


def read_dictionary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``pos, term``: one term per line; duplicates and blank lines count."""
    lines = in_order(read_lines(spark, path), LINE_ORDER, position="pos")
    return lines.select("pos", F.col("value").alias("term"))


def read_loadspec(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines; a malformed line stops the job."""
    return spark.read.schema(schemas.LOADSPEC).json(path, mode="FAILFAST")


def read_requests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per-request rows written by :func:`loadlab.sources.writers.write_requests`."""
    return spark.read.schema(schemas.REQUEST).csv(path, header=True, mode="FAILFAST")


def slice_documents(df: DataFrame, order: list[str], offset: int = 0, total: int = 0) -> DataFrame:
    """``total`` documents after the first ``offset`` in the order of ``order``; 0 means all.

    Only the ``order`` columns, which identify a document, are numbered; the
    documents between the first and the last wanted one are then filtered, so
    they are neither sorted nor copied.
    """
    if not offset and not total:
        return df
    numbered = in_order(df.select(*order), order, position="_n")
    wanted = [F.col("_n") == offset] + ([F.col("_n") == offset + total - 1] if total else [])
    ends = numbered.where(reduce(or_, wanted)).orderBy("_n").collect()  # two rows at most
    if not ends or ends[0]["_n"] != offset:
        return df.limit(0)
    place = F.struct(*order)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def at(row) -> Column:
        return F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in order])

    chosen = df.where(place >= at(ends[0]))
    return chosen.where(place <= at(ends[1])) if len(ends) > 1 else chosen.where(place <= at(ends[0])) if total == 1 else chosen


def read_documents(
    spark: SparkSession, path: str | list[str], offset: int = 0, total: int = 0
) -> DataFrame:
    """An exported index, one JSON document per line: ``file, block, line, body``.

    A slice is taken in two passes, and numbers of lines follow the splits of a read, which may differ from one to the
    next; so the lines are staged first.
    """
    lines = read_lines(spark, path).withColumnRenamed("value", "body")
    if offset or total:
        lines = stage(lines, "lines")
    return slice_documents(lines, LINE_ORDER, offset, total)


def read_node_stats(spark: SparkSession, path: str | list[str], one_per_line: bool = False) -> DataFrame:
    """Stored node-stats responses, one per file or one per line: ``poll_ts, node_id, stats``."""
    bodies = spark.read.text(path, wholetext=not one_per_line).select(F.col("value").alias("body"))
    return nodes.parse_polls(bodies)


def _entry(line: Column) -> list[Column]:
    """Field (where one begins), key and anon of a line written by
    :func:`loadlab.sources.writers.write_pseudonyms`, and whether it is one."""
    string = r'("(?:[^"\\\\]|\\\\.)*")'
    form = rf"^(?:\{{|\}},|,)(?:{string}:\{{)?{string}:{string}(?:\}}\}})?$"
    parts = [F.nullif(F.regexp_extract(line, form, i), F.lit("")) for i in (1, 2, 3)]
    plain = [F.from_json(F.concat(F.lit('{"v":'), part, F.lit("}")), "v string")["v"] for part in parts]
    is_entry = F.regexp_like(line, F.lit(form)) | (line == "{}")
    return [*[p.alias(n) for p, n in zip(plain, ("field", "key", "anon"))], is_entry.alias("_is_entry")]


def read_pseudonyms(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A pseudonym dictionary ``field, key, anon``; empty for an empty path.

    ``json`` is the exchanged single-object form ``{field: {key: anon}}``.
    """
    if not path:
        return spark.createDataFrame([], schemas.PSEUDONYMS)
    if format == "json":
        lines = in_order(read_lines(spark, path), LINE_ORDER, position="_n")
        parts = lines.select("_n", *_entry(F.col("value")))
        if parts.where("not _is_entry").isEmpty():
            known = carry_forward(parts, ["field"], "_n", BLOCK_ROWS)
            return known.where("key is not null").select("field", "key", "anon")
        # Not written here: any layout, one object per file.
        text = spark.read.text(path, wholetext=True)
        maps = text.select(F.from_json("value", "map<string,map<string,string>>").alias("fields"))
        return maps.select(F.explode("fields").alias("field", "_keys")).select("field", F.explode("_keys").alias("key", "anon"))
    return spark.read.schema(schemas.PSEUDONYMS).format(format).load(path)
