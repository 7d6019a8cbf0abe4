"""State and sequence across micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from loadlab.operators import sketches
from loadlab.plans import loadspecs
from loadlab.streaming import batches, late, loadspec, ordered
from loadlab.streaming.pseudonyms import read_dictionary, stream_pseudonymise


def lagged(rows):
    out, last = [], {}
    for k, t, o in sorted(rows, key=lambda r: (r[1], r[2])):
        out.append((k, t, o, t - last.get(k, t)))
        last[k] = t
    return out


def run_ordered(spark, path, parts, **options):
    for rows in parts:
        spark.createDataFrame(rows, "k string, t long, delay_key long").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("k string, t long, delay_key long").parquet(f"{path}/in")
        ordered.stream_delays_unordered(stream, "k", "t", ["delay_key"], f"{path}/out", f"{path}/c", **options).awaitTermination()
    out = spark.read.schema("k string, t long, delay_key long, delay long").parquet(f"{path}/out")
    return sorted(map(tuple, out.collect()), key=str)


def test_rows_in_any_order_within_the_watermark(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(60) * 1_000_000 + draw.randrange(3) * 400, i) for i in range(300)]
    # A row comes up to 20 seconds after others.
    arrival = sorted(rows, key=lambda r: r[1] + draw.randrange(20_000_000))
    parts = [arrival[i : i + 100] for i in (0, 100, 200)]
    got = run_ordered(spark, str(tmp_path), parts, watermark="30 seconds")
    passed = max(r[1] for r in rows) // 1000 * 1000 - 30_000_000
    assert got == sorted([r for r in lagged(rows) if r[1] < passed], key=str)
    assert len(got) > 100


def test_idle_keys_are_forgotten(spark, tmp_path):
    second = 1_000_000
    parts = [[("a", 1 * second, 0), ("b", 2 * second, 1)], [("b", 40 * second, 2)], [("b", 50 * second, 3), ("a", 60 * second, 4)], [("b", 200 * second, 5)]]
    parts[0].append((None, None, 6))
    got = run_ordered(spark, str(tmp_path / "kept"), parts, watermark="5 seconds")
    assert [r[3] for r in got if r[0] == "a"] == [0, 59 * second] and [r[3] for r in sorted(got, key=lambda r: r[1]) if r[0] == "b"] == [0, 38 * second, 10 * second]
    got = run_ordered(spark, str(tmp_path / "gone"), parts, watermark="5 seconds", forget_after_seconds=30)
    assert [r[3] for r in got if r[0] == "a"] == [0, 0] and [r[3] for r in sorted(got, key=lambda r: r[1]) if r[0] == "b"] == [0, 0, 10 * second]


LINE = (
    '[2024-01-01 00:{m:02d}:{s:02d},{ms:03d}][WARN ][index.search.slowlog.query] [h] [i][0] took[1ms], took_millis[1], types[t], stats[], '
    'search_type[QUERY_THEN_FETCH], total_shards[1], source[{{"n":{n}}}], extra_source[]'
)


def lines_of(times):
    return [(n, LINE.format(m=t // 60000, s=t // 1000 % 60, ms=t % 1000, n=n)) for n, t in times]


@pytest.mark.parametrize("options", [{}, {"indexes": ["x", "y", "z"], "server": "http://s:1/ignored"}, {"max_duration_seconds": 31}])
def test_loadspec_goes_on_from_batch_to_batch(spark, tmp_path, options):
    draw = random.Random(2)
    times = sorted(draw.randrange(0, 90_000) // 40 * 40 for _ in range(60))
    rows = lines_of(enumerate(times)) + [(1000, "junk"), (1001, LINE.replace("query]", "fetch]").format(m=0, s=0, ms=0, n=0))]
    parts = [rows[:20] + rows[60:], rows[20:21], rows[21:45], rows[45:60]]
    path = str(tmp_path)
    for part in parts:
        draw.shuffle(part)
        spark.createDataFrame(part, "ord long, value string").repartition(2).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("ord long, value string").parquet(f"{path}/in")
        loadspec.stream_loadspec(stream, f"{path}/out", f"{path}/c", ["ord"], **options).awaitTermination()
    whole = loadspecs.from_slowlog(spark.createDataFrame(rows, "ord long, value string"), order=["ord"], **options)
    got = sorted(map(tuple, loadspec.read_loadspec(spark, f"{path}/out").collect()))
    # Equal times at the border of two batches keep their order, as the batches came in that order.
    assert got == sorted(map(tuple, whole.select(*loadspecs.COLUMNS).collect()))
    assert loadspec.late_requests(spark, f"{path}/out").count() == 0


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    first, second, third = [lines_of(p) for p in ([(0, 5000), (1, 7000)], [(2, 9000), (3, 6000)], [(4, 9000)])]
    for number, part in ((0, first), (0, first), (1, second), (1, second), (2, third)):
        loadspec.sequence_batch(spark.createDataFrame(part, "ord long, value string"), number, path, ["ord"], None, [], 0)
    got = sorted((r.id, r.delay_since_last_nanos // 1_000_000) for r in loadspec.read_loadspec(spark, path).collect())
    assert got == [(0, 0), (1, 2000), (2, 2000), (3, 0)]
    assert [r.ord for r in loadspec.late_requests(spark, path).collect()] == [3]
    carried = spark.read.parquet(f"{path}/carry/batch=2").first()
    assert (carried.requests, carried.late) == (4, 1)


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    path = str(tmp_path)
    measures = {**late.histogram(F.col("v")), **late.counter("odd", F.col("v") % 2 == 1)}

    def arrive(rows):
        spark.createDataFrame(rows, "ts long, v long").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("ts long, v long").parquet(f"{path}/in")
        late.stream_ticks(stream, measures, f"{path}/out", f"{path}/c", 5, allowed_seconds=2).awaitTermination()

    arrive([(1, 1), (3, 2), (None, 9)])
    arrive([(12, 3), (4, 5)])
    arrive([(4, 7), (11, None), (13, 4), (9, 8)])
    found = {r.ts: (r["count"], r.odd, r.exact) for r in sketches.quantiles(late.ticks_so_far(spark, f"{path}/out", measures)).collect()}
    assert found == {5: (3, 2, True), 15: (2, 1, True)}
    assert sorted(map(tuple, late.late_rows(spark, f"{path}/out").collect())) == [(4, 7), (9, 8)]
    assert tuple(late.arrivals_so_far(spark, f"{path}/out").first()) == (13, 9, 2, 1)


def test_folds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "FOLD_EVERY", 4)
    folder = str(tmp_path / "f")
    schema = spark.createDataFrame([], "ts long, v long").schema

    def merge(parts):
        return batches.newest_rows(parts, ["ts"], schema)

    for number in range(23):
        batches.write_batch(spark.createDataFrame([(number % 3, number), (100 + number, 0)], schema), folder, number)
        batches.fold(spark, folder, number, schema, merge)
        last, later = batches.folders(spark, folder)
        assert len(later) + (last is not None) <= 5
        newest = {r.ts: r.v for r in batches.newest(spark, folder, ["ts"], schema).collect()}
        expected = {100 + n: 0 for n in range(number + 1)} | {n % 3: n for n in range(number + 1)}
        assert newest == expected
    # What is no longer read has gone, but for the fold before the last.
    names = sorted(p.name for p in (tmp_path / "f").iterdir())
    assert names == ["batch=16", "batch=17", "batch=18", "batch=19", "batch=20", "batch=21", "batch=22", "folded=15", "folded=19"]
    # A batch that runs again after its fold reads what was before it; a fold that was not finished does not count.
    assert batches.read_before(spark, folder, 19, schema).where("v = 18").count() == 1
    (tmp_path / "f" / "folded=19" / batches.MARKER).unlink()
    assert batches.folders(spark, folder) == (15, [16, 17, 18, 19, 20, 21, 22])


def test_pseudonyms_over_folds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "FOLD_EVERY", 2)
    path = str(tmp_path)
    known = spark.createDataFrame([("user", "zed", "7")], "field string, key string, anon string")
    parts = [[(0, "ann"), (1, "bob")], [(2, "bob"), (3, "cy")], [(4, "zed"), (5, "ann")], [(6, "dee")], [(7, "cy"), (8, "eve")]]
    for part in parts:
        spark.createDataFrame(part, "_id long, user string").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("_id long, user string").parquet(f"{path}/in")
        stream_pseudonymise(stream, {"user": "(.*)"}, ["_id"], f"{path}/out", f"{path}/map", f"{path}/c", known).awaitTermination()
    got = {r._id: r.user for r in batches.read_all(spark, f"{path}/out").collect()}
    assert got == {0: "8", 1: "9", 2: "9", 3: "10", 4: "7", 5: "8", 6: "11", 7: "10", 8: "12"}
    names = {r.key: r.anon for r in read_dictionary(spark, f"{path}/map").collect()}
    assert names == {"ann": "8", "bob": "9", "cy": "10", "dee": "11", "eve": "12"}
