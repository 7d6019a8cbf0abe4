"""Attribution in buckets and on streams."""

import pytest
from pyspark.sql import functions as F

from loadlab.operators import attribution
from loadlab.sources import bucketed
from loadlab.streaming import attribution as streamed


def tables(spark):
    spec = spark.range(200).select("id", F.lit(0).cast("long").alias("delay_since_last_nanos"), F.concat(F.lit("u"), F.col("id") % 7).alias("url"), F.lit("s").alias("source"))
    requests = spark.range(0, 200, 3).select(
        (F.col("id") * 2).alias("ts"), F.lit(200).alias("code"), F.col("id").alias("took_in_millis"), F.col("id").alias("latency_micros"), "id"
    )
    return spec, requests


def test_buckets_join_where_they_lie(spark, tmp_path):
    spec, requests = tables(spark)
    bucketed.write_loadspec_table(spec, "spec_a", f"{tmp_path}/spec", 8)
    bucketed.write_request_table(requests, "requests_a", f"{tmp_path}/requests", 8)
    # As another session opens them.
    spark.sql("DROP TABLE spec_a")
    stored_spec = bucketed.open_loadspec_table(spark, "spec_b", f"{tmp_path}/spec", 8)
    stored_requests = bucketed.open_request_table(spark, "requests_a", f"{tmp_path}/requests", 8)
    for make in (attribution.attribute, lambda r, s: attribution.unsent(s, r)):
        joined = make(stored_requests, stored_spec)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, make(requests, spec).collect()))
    by = attribution.latency_by(stored_requests, stored_spec)
    # Groups are shuffled, rows of requests are not.
    below = by._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1]
    assert "Exchange" not in below
    assert sorted(map(tuple, by.collect())) == sorted(map(tuple, attribution.latency_by(requests, spec).collect()))
    # One file a bucket, and written again it is replaced.
    bucketed.write_request_table(requests.limit(5), "requests_a", f"{tmp_path}/requests", 8)
    assert spark.table("requests_a").count() == 5
    with pytest.raises(ValueError):
        bucketed.write_bucketed(requests, "a; DROP TABLE b", f"{tmp_path}/x")
    for name in ("spec_b", "requests_a"):
        spark.sql(f"DROP TABLE {name}")


def test_unsent_leave_when_the_watermark_passes(spark, tmp_path):
    folder, queries = str(tmp_path), {}

    def arrive(sent, answers):
        rows = [(i, t, None) for i, t in sent] + [(i, None, t) for i, t in answers]
        df = spark.createDataFrame(rows, "id long, s long, r long").select(
            "id", F.timestamp_seconds("s").alias("sent_time"), F.timestamp_seconds("r").alias("time")
        )
        df.coalesce(1).write.mode("append").parquet(folder + "/in")
        for name, part in (("unsent", streamed.unsent), ("answered", streamed.answered)):
            stream = spark.readStream.schema(df.schema).parquet(folder + "/in")
            sides = stream.where("sent_time is not null").select("id", "sent_time"), stream.where("time is not null").select("id", "time")
            writer = part(streamed.attributed(*sides, 10, watermark="5 seconds")).writeStream.format("parquet")
            queries[name] = writer.option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-c").trigger(availableNow=True).start()
            queries[name].awaitTermination()

    def ids(name):
        return sorted(r.id for r in spark.read.schema("id long").parquet(f"{folder}/{name}").collect())

    # 2 is answered before its entry is seen, 3 too late, 4 never; no id is no entry.
    arrive([(1, 100), (3, 101), (None, 101)], [(2, 104)])
    arrive([(2, 103), (4, 105)], [(1, 104), (3, 115)])
    assert ids("answered") == [1, 2] and ids("unsent") == []
    arrive([(9, 300)], [(9, 301)])
    assert ids("answered") == [1, 2, 9] and ids("unsent") == [3, 4]
    # What has left is no state any more.
    kept = queries["unsent"].lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 2
