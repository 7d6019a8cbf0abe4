"""Compare registered queries with their SQL: names, types and row multisets.

``python tests/oracle.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import collections
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(spark, con, sf_dir: str, run, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    rows = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}"
    at = [names.index(c) for c in columns]
    expected = collections.Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    sql_types = {d[0]: d[1] for d in con.execute("DESCRIBE " + sql).fetchall()}
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c in columns:
        if KINDS.get(spark_types[c], spark_types[c]) != sql_types[c]:
            return f"type of {c}: {spark_types[c]} vs {sql_types[c]}"
    if rows != expected:
        missing, extra = expected - rows, rows - expected
        return (
            f"{sum(rows.values())} vs {sum(expected.values())} rows; missing {sum(missing.values())} "
            f"{list(missing)[:2]}; extra {sum(extra.values())} {list(extra)[:2]}"
        )
    return None


def main(arguments: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{arguments[0] if arguments else '0.01'}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if len(arguments) > 1 and name not in arguments[1:]:
            continue
        started = time.time()
        try:
            if name in oracles:
                wrong = difference(spark, con, sf_dir, run, oracles[name])
            else:
                wrong = None if run(spark, sf_dir).count() else "no rows"
        except Exception as error:  # one line per query, whatever happens
            wrong = f"{type(error).__name__}: {str(error)[:600]}"
        bad += wrong is not None
        print(f"{'ok  ' if wrong is None else 'FAIL'} {name} {time.time() - started:.1f}s {wrong or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
