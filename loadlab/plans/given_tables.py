"""The given tables in the shapes the operators read.

Slow-log lines, responses and node polls do not come with the tables, so Spark
renders them from ``events`` and ``orders``: row by row, nothing left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlab.functions.outcomes import retry_after_millis
from loadlab.operators.sequence import in_order
from loadlab.session import new_folder, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that is a single row group; large tables have
    more splits than cores and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slowlog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slow-log line per event: ``ord, value``.

    Signups are logged by the fetch log; some error lines have a broken body or
    a date without time, as real logs do.
    """
    events = spread(table(spark, sf_dir, "events"))
    rendered = F.expr("""
        concat('[',
          if(event_type = 'error' and value >= 200, date_format(ts, 'yyyy-MM-dd'), date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')),
          '][WARN ][index.search.slowlog.', if(event_type = 'signup', 'fetch', 'query'),
          '] [host', user_id % 3, '] [', event_type, '][', user_id % 5,
          '] took[', value, 'ms], took_millis[', cast(floor(value) as bigint),
          '], types[', if(value >= 50, 'doc', ''), '], stats[], search_type[',
          if(value >= 100, 'DFS_QUERY_THEN_FETCH', 'QUERY_THEN_FETCH'),
          '], total_shards[5], source[{"size": ', user_id, ', "preference": "user-', user_id,
          '", "query": {"term": {"k": ', get_json_object(props, '$.k'), '}}',
          if(event_type = 'error' and value < 5, '', '}'), '], extra_source[]')
        """)
    # A one-row generator: a filter on the line does not render it a second time.
    return events.select(F.col("event_id").alias("ord"), F.inline(F.array(F.struct(rendered.alias("value")))))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came back for each event taken as a request; ``code`` NULL means the
    request failed in transport."""
    events = table(spark, sf_dir, "events")
    code = """
        case when event_type = 'error' then
               case user_id % 5 when 0 then 503 when 1 then 429 when 2 then 500 when 3 then 301 end
             when cast(get_json_object(props, '$.k') as int) < 3 then 404
             else 200 end"""
    return events.select(
        F.col("event_id").alias("id"),
        F.expr("unix_seconds(cast(ts as timestamp))").alias("ts"),
        F.expr(code).alias("code"),
        F.expr("cast(floor(value) as bigint)").alias("took_in_millis"),
        F.expr("cast(floor(value * 1000) as bigint) + 150").alias("latency_micros"),
        F.expr("concat(user_id % 7, '.5')").alias("retry_after"),
    ).withColumn("pause_millis", retry_after_millis(F.col("retry_after")))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, term``: of every turn in ``conversations``, in order, each line of
    its text, then each of its words as it first occurs."""
    turns = table(spark, sf_dir, "conversations")
    lines = F.split("text", "\n")
    words = F.array_distinct(F.split("text", "[ \n]"))
    terms = turns.select("conv_id", "turn", F.posexplode(F.concat(lines, words)).alias("part", "term"))
    return in_order(terms, ["conv_id", "turn", "part"], position="pos").select("pos", "term")


def node_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll body per order, ``poll_id, body``: the order's priority class is the node."""
    orders = spread(table(spark, sf_dir, "orders"))
    body = """
        concat('{"cluster_name":"c","nodes":{"node-', substr(o_orderpriority, 1, 1), '":{"timestamp":', t * 1000,
          ',"os":{"mem":{"total_in_bytes":', c * 100, ',"used_in_bytes":', c, '},"swap":{"total_in_bytes":0,"used_in_bytes":0}}',
          ',"process":{"cpu":{"percent":', k % 100, ',"total_in_millis":', k * 10, '}}',
          ',"jvm":{"mem":{"heap_used_in_bytes":', c * 3, ',"heap_committed_in_bytes":', c * 5,
          ',"non_heap_used_in_bytes":', c + 1, ',"non_heap_committed_in_bytes":', c + 2,
          ',"pools":{"young":{"used_in_bytes":', k + 1, ',"max_in_bytes":', k + 2,
          '},"survivor":{"used_in_bytes":', k + 3, ',"max_in_bytes":', k + 4,
          '},"old":{"used_in_bytes":', k + 5, ',"max_in_bytes":', k + 6,
          '}}},"gc":{"collectors":{"young":{"collection_count":', k + 7, ',"collection_time_in_millis":', k + 8,
          '},"old":{"collection_count":', k + 9, ',"collection_time_in_millis":', k + 10, '}}}}}}}')"""
    named = orders.selectExpr(
        "o_orderkey as k", "o_custkey as c", "unix_seconds(cast(o_orderdate as timestamp)) as t", "o_orderpriority"
    )
    return named.select(F.col("k").alias("poll_id"), F.expr(body).alias("body"))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits out of ``pages``: an id, a URL, a nested source and a list of links."""
    html_lang = F.regexp_extract("html", 'lang="([^"]+)"', 1)
    return spread(table(spark, sf_dir, "pages")).select(
        F.col("page_id").alias("_id"),
        "url",
        F.struct(
            F.col("url").alias("url"), html_lang.alias("lang"), F.length("html").alias("size"), F.col("html").alias("html")
        ).alias("_source"),
        F.array(
            F.struct(F.concat(F.col("url"), F.lit("#top")).alias("url")), F.struct(F.lit("mailto:x").alias("url"))
        ).alias("links"),
    )


def replay(df: DataFrame, by: str, start, arrivals: int = 3, delayed: Column | None = None) -> None:
    """Let all of ``df`` arrive in the order of ``by``, and run a stream over each arrival.

    ``start(stream)`` starts a query that ends when it has read all files there
    are; every arrival resumes it from its checkpoint.  Rows that are ``delayed`` come with the next arrival.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "arriving")
    # Rendered once, not for every arrival.
    df = stage(df, "to-arrive")
    low, high = df.agg(F.min(by), F.max(by)).first()
    part = F.floor((F.col(by) - low) * arrivals / (high - low + 1))
    if delayed is not None:
        part = part + delayed.cast("int")
    part = F.least(part, F.lit(arrivals - 1))
    for number in range(arrivals):
        df.where(part == number).write.mode("append").parquet(folder)
        start(spark.readStream.schema(df.schema).parquet(folder)).awaitTermination()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, code, body, retry_after, latency_nanos``: a raw response per event."""
    events = spread(table(spark, sf_dir, "events"))
    body = """
        if(event_type = 'error',
           concat('{"error":{"type":"type-', user_id % 4, '","reason":"reason ', user_id, '"},"status":500}'),
           concat('{"took":', cast(floor(value) as bigint), ',"timed_out":false,"hits":{"total":', user_id, ',"hits":[]}}'))"""
    return events.selectExpr(
        "event_id as id",
        f"{body} as body",
        "if(event_type = 'error', concat(user_id % 7, '.25'), null) as retry_after",
        "cast(floor(value * 1000000) as bigint) as latency_nanos",
    )
