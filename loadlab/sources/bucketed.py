"""Loadspecs and request rows kept in buckets of their id, so that they join where they lie.

Both are written once in the same number of buckets, sorted by id.  Every later question about both
(attribution, unsent entries, latency by URL) joins bucket with bucket: no request body is shuffled again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loadlab import schemas

#: Buckets of some hundred megabytes at a billion requests; both sides must have the same number.
BUCKETS = 256


def _checked(table: str) -> str:
    if not re.fullmatch(r"\w+(\.\w+)?", table, re.ASCII):
        raise ValueError(f"not a table name: {table!r}")
    return table


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int = BUCKETS, by: str = "id") -> None:
    """Write ``df`` below ``path`` as ``table`` of the session's catalog, replacing what is there.

    One shuffle, dealt as the buckets are, so that a bucket is one file of one task.
    """
    dealt = df.repartition(buckets, by)
    writer = dealt.write.bucketBy(buckets, by).sortBy(by).format("parquet").option("path", path)
    writer.mode("overwrite").saveAsTable(_checked(table))


def open_bucketed(spark: SparkSession, table: str, path: str, schema: str, buckets: int = BUCKETS, by: str = "id") -> DataFrame:
    """A bucketed table that another session wrote below ``path``."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_checked(table)} ({schema}) USING parquet OPTIONS (path '{path}') "
        f"CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {int(buckets)} BUCKETS"
    )
    return spark.table(table)


def write_loadspec_table(loadspec: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    write_bucketed(loadspec.select("id", "delay_since_last_nanos", "url", "source"), table, path, buckets)


def write_request_table(requests: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    write_bucketed(requests.select("ts", "code", "took_in_millis", "latency_micros", "id"), table, path, buckets)


def open_loadspec_table(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    return open_bucketed(spark, table, path, schemas.LOADSPEC, buckets).hint("merge")


def open_request_table(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    return open_bucketed(spark, table, path, schemas.REQUEST, buckets).hint("merge")
