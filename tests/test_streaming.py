from pyspark.sql import functions as F

from loadlab.plans import given_tables
from loadlab.streaming import batches, delays, slowlog, ticks
from loadlab.sources import readers
from test_slowlog import BARE, FULL


def run_delays(spark, path, parts):
    for number, rows in enumerate(parts):
        spark.createDataFrame(rows, "k string, t long, ord long").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("k string, t long, ord long").parquet(f"{path}/in")
        delays.stream_delays(
            stream, "k", "t", ["ord"], f"{path}/out", f"{path}/state", f"{path}/checkpoint"
        ).awaitTermination()
    out = batches.read_all(spark, f"{path}/out").orderBy("ord").collect()
    return [(r.ord, r.delay, r.late) for r in out]


def test_delays_across_batches_and_late_rows(spark, tmp_path):
    parts = [
        [("a", 10, 0), ("b", 12, 1), ("a", 15, 2)],
        [("a", 20, 3), ("c", 21, 4)],
        [("b", 30, 5), ("a", 18, 6), ("a", 25, 7), (None, 1, 8)],
    ]
    got = run_delays(spark, str(tmp_path), parts)
    assert got == [
        (0, 0, False), (1, 0, False), (2, 5, False), (3, 5, False), (4, 0, False),
        (5, 18, False), (6, 0, True), (7, 7, False), (8, 0, False),
    ]


def test_repeated_batch_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "x int")
    folder = str(tmp_path / "f")
    for _ in range(2):
        batches.write_batch(rows, folder, 0)
    batches.write_batch(rows, folder, 1)
    assert batches.read_all(spark, folder).count() == 2
    assert batches.read_before(spark, folder, 1, "x int").count() == 1
    assert batches.read_before(spark, folder, 0, "x int").count() == 0


def test_late_rows_of_closed_ticks_are_dropped(spark, tmp_path):
    folder = str(tmp_path)

    def arrive(times):
        df = spark.createDataFrame([(t, t) for t in times], "s long, v long").select(
            F.timestamp_seconds("s").alias("time"), "v"
        )
        df.coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema("time timestamp, v long").parquet(folder + "/in")
        report = ticks.histogram_ticks(stream, "v", 5, watermark="2 seconds")
        writer = report.writeStream.format("parquet").option("checkpointLocation", folder + "/checkpoint")
        writer.option("path", folder + "/out").trigger(availableNow=True).start().awaitTermination()

    arrive([1, 2, 3])
    arrive([11, 12])
    arrive([2, 30])
    rows = spark.read.parquet(folder + "/out").orderBy("ts").collect()
    assert [(r.ts, r["count"], r.p50) for r in rows] == [(5, 3, 2.0), (15, 2, 11.5)]


def test_reports_hold_the_current_tick(spark, tmp_path):
    folder = str(tmp_path)

    def arrive(times):
        df = spark.createDataFrame([(t, t) for t in times], "s long, v long").select(
            F.timestamp_seconds("s").alias("time"), "v"
        )
        df.coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema("time timestamp, v long").parquet(folder + "/in")
        made = {
            "h": ticks.histogram_ticks(stream, "v", 5, watermark="2 seconds"),
            "c": ticks.counter_ticks(stream, F.col("v") > 1, 5, watermark="2 seconds"),
            "g": ticks.gauge_ticks(stream, ["v"], F.col("time"), 5, watermark="2 seconds"),
        }
        for name, rows in made.items():
            batches.write_updates(rows, f"{folder}/{name}", f"{folder}/{name}-c").awaitTermination()
        return {name: batches.newest(spark, f"{folder}/{name}", ["ts"], rows.schema) for name, rows in made.items()}

    def report(found):
        rows = lambda df: [tuple(r)[:2] for r in df.orderBy("ts").collect()]
        return (
            rows(ticks.histogram_so_far(found["h"], 5)), rows(ticks.counter_so_far(found["c"], 5)), rows(ticks.gauges_so_far(found["g"], ["v"], 5)),
        )

    assert report(arrive([1, 2])) == ([(5, 2)], [(5, 1)], [(5, 2)])
    expected = [(5, 3), (10, 0), (15, 2)], [(5, 2), (10, 2), (15, 4)], [(5, 3), (10, 3), (15, 12)]
    assert report(arrive([3, 11, 12])) == expected


def test_slowlog_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes((FULL + "\r\njunk types[\n" + BARE + "\n").encode())
    for name, transform in (("ok", slowlog.parsed_requests), ("bad", slowlog.rejected_lines)):
        lines = readers.stream_lines(spark, str(tmp_path / "in"))
        writer = transform(lines).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / name / "c"))
        writer.option("path", str(tmp_path / name / "o")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok" / "o")).count() == 2
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "bad" / "o")).collect()] == ["no match"]


def test_a_replay_renders_its_rows_once(spark, tmp_path):
    rendered = spark.sparkContext.accumulator(0)

    def render(i):
        rendered.add(1)
        return i * 10

    rows = spark.range(100, numPartitions=2).withColumn("at", F.udf(render, "long")("id"))
    out = str(tmp_path / "out")

    def start(stream):
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        return writer.trigger(availableNow=True).start()

    given_tables.replay(rows, "at", start, delayed=F.col("id") % 7 == 0)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(i, i * 10) for i in range(100)]
    assert rendered.value == 100
