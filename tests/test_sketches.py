import random

import pytest
from pyspark.sql import functions as F

from loadlab import fixed_values as fixed
from loadlab.operators import reports, sketches
from loadlab.streaming import batches, ticks


def nearest_rank(values, q):
    values = sorted(values)
    return values[max(0, -(-int(round(q * len(values) * 1e6)) // 1_000_000) - 1)]


def table(spark, n, seed=1):
    draw = random.Random(seed)
    rows = [(draw.randrange(0, 100), draw.choice("ab"), draw.choice([None, int(draw.expovariate(0.01))])) for _ in range(n)]
    rows.append((None, "a", 5))
    return rows, spark.createDataFrame(rows, "ts long, url string, v long").repartition(5)


def test_small_ticks_are_exact_and_merge(spark):
    rows, df = table(spark, 3000)
    stored = sketches.tick_sketches(df, F.col("v"), 10, ["url"])
    for interval, keys in ((10, ["url"]), (10, []), (50, ["url"]), (100, [])):
        found = sketches.quantiles(sketches.merged(stored, interval, keys)).collect()
        groups = {}
        for ts, url, v in rows:
            if ts is not None:
                key = ((url,) if keys else ()) + ((ts // interval + 1) * interval,)
                groups.setdefault(key, []).extend([] if v is None else [v])
        assert len(found) == len(groups)
        for r in found:
            values = groups[tuple(r[k] for k in [*keys, "ts"])]
            assert r["count"] == len(values) and r.exact == (len(values) <= sketches.SIZE)
            if r.exact:
                assert [r[n] for n in fixed.QUANTILE_NAMES] == [nearest_rank(values, q) for q in fixed.QUANTILES]


def test_ranks_are_within_the_stated_error(spark):
    rows, df = table(spark, 40_000)
    stored = sketches.tick_sketches(df, F.col("v"), 10, size=256)
    days = sketches.merged(stored, 100)
    found = sketches.outside(days, df, F.col("v"), 100, size=256).collect()
    assert [r.outside for r in found] == [0] and not sketches.quantiles(days, 256).first().exact
    # The check finds a sketch that is off: one of other values.
    wrong = sketches.merged(sketches.tick_sketches(df, F.col("v") * 2, 10, size=256), 100)
    assert sketches.outside(wrong, df, F.col("v"), 100, size=256).first().outside > 0


def test_ticks_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None), (31, 7)], "ts long, v long")
    stored = sketches.tick_sketches(df, F.col("v"), 10)
    report = [tuple(r) for r in sketches.sketched_report(stored, 10).orderBy("ts").collect()]
    nothing = (None,) * 4
    assert report == [(10, 0, *nothing), (20, 0, *nothing), (30, 0, *nothing), (40, 1, *[7.0] * 4)]
    assert sketches.sketched_report(stored.limit(0), 10).count() == 0
    assert [r["count"] for r in sketches.merged(stored, 40).collect()] == [1]


@pytest.mark.parametrize("approx", [False, True])
def test_stream_counts_what_batch_counts(spark, tmp_path, approx):
    rows = [(1, 4), (2, None), (7, None), (11, 6), (12, 8), (13, None)]
    df = spark.createDataFrame(rows, "s long, v long")
    df.select(F.timestamp_seconds("s").alias("time"), "v").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("time timestamp, v long").parquet(f"{tmp_path}/in")
    ticked = ticks.histogram_ticks(stream, "v", 5, approx=approx)
    batches.write_updates(ticked, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    so_far = ticks.histogram_so_far(batches.newest(spark, f"{tmp_path}/out", ["ts"], ticked.schema), 5)
    got = [tuple(r) for r in so_far.orderBy("ts").collect()]
    batch = [tuple(r) for r in reports.histogram_report(df, F.col("v"), 5, time="s").orderBy("ts").collect()]
    assert [g[:2] for g in got] == [b[:2] for b in batch] == [(5, 1), (10, 0), (15, 2)]
    assert approx or got == batch


def test_stored_ticks_of_a_stream_merge(spark, tmp_path):
    def arrive(rows):
        df = spark.createDataFrame(rows, "s long, v long").select(F.timestamp_seconds("s").alias("time"), "v")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("time timestamp, v long").parquet(f"{tmp_path}/in")
        ticked = ticks.sketch_ticks(stream, "v", 5, watermark="5 seconds")
        batches.write_updates(ticked, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
        return batches.newest(spark, f"{tmp_path}/out", ["ts"], ticked.schema)

    arrive([(1, 10), (2, 20), (6, 30)])
    stored = arrive([(7, 40), (8, None), (12, 50)])
    found = [tuple(r) for r in sketches.quantiles(sketches.merged(stored, 20)).collect()]
    assert found == [(20, 5, 30, 50, 50, 50, True)]
