import os

import pytest
from pyspark.sql import Observation, functions as F

from loadlab import fixed_values as fixed, session
from loadlab.operators import reports as report_ops, requests
from loadlab.plans import loadspecs, reports
from loadlab.sources import readers
from test_hits_and_reports import attempts, rows
from test_slowlog import BARE, FULL


@pytest.mark.parametrize("approx", [False, True])
def test_one_pass_gives_what_each_report_gives(spark, approx):
    a = attempts(spark).unionByName(attempts(spark).where("id = 0").withColumn("ts", F.lit(None).cast("long")))
    series = reports.report_series(a, interval=5, approx=approx)
    assert rows(series[fixed.REQUESTS_SENT]) == rows(report_ops.requests_sent_report(a, 5))
    assert rows(series[fixed.ERRORS]) == rows(report_ops.errors_report(a, 5))
    for name, report in ((fixed.RESPONSE_TIME, report_ops.response_time_report), (fixed.PAUSE_TIME, report_ops.pause_report)):
        got, expected = rows(series[name]), rows(report(a, 5))
        assert [g[:2] for g in got] == [e[:2] for e in expected]
        if not approx:
            assert got == expected


def test_attempts_are_read_once_for_the_series(spark, tmp_path):
    attempts(spark).write.parquet(str(tmp_path / "a"))
    reads = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(id):
        reads.add(1)
        return id

    counted = spark.read.parquet(str(tmp_path / "a")).withColumn("took_in_millis", seen("took_in_millis"))
    for report in reports.report_series(counted, interval=5).values():
        report.collect()
    assert reads.value == 9


def test_all_files_or_none(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    written = reports.write_requests

    def failing(*_):
        raise RuntimeError("disk full")

    monkeypatch.setattr(reports, "write_requests", failing)
    with pytest.raises(RuntimeError):
        reports.write_reports(attempts(spark), out, "1", interval=5)
    assert os.listdir(out) == []
    monkeypatch.setattr(reports, "write_requests", written)
    reports.write_reports(attempts(spark), out, "1", interval=5)
    names = {f"{n}_1.csv" for n in (fixed.RESPONSE_TIME, fixed.PAUSE_TIME, fixed.REQUESTS_SENT, fixed.ERRORS, fixed.REQUEST)}
    assert set(os.listdir(out)) == names
    # Nothing that is there is replaced, and nothing new appears beside it.
    before = {n: sorted(os.listdir(f"{out}/{n}")) for n in names}
    with pytest.raises(FileExistsError):
        reports.write_reports(attempts(spark).limit(2), out, "1", interval=5)
    assert {n: sorted(os.listdir(f"{out}/{n}")) for n in os.listdir(out)} == before


def test_what_had_moved_goes_back(spark, tmp_path):
    folder = tmp_path / "f"
    with pytest.raises(OSError):
        with session.published(spark, str(folder)) as aside:
            for name in ("a", "b"):
                os.makedirs(f"{aside}/{name}")
            # A target that appears while the others move.
            original = os.listdir(aside)
            assert sorted(original) == ["a", "b"]
            raise OSError("lost")
    assert os.listdir(folder) == []


def test_lines_are_counted_on_the_way(spark):
    other = FULL.replace("slowlog.query", "slowlog.fetch")
    lines = [FULL, BARE, other, "junk", FULL.replace(" 08:15:59,041", ""), FULL.replace('{"from"', "{from")]
    lines += [FULL] * 3
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        reads.add(1)
        return value

    df = spark.createDataFrame(list(enumerate(lines)), "ord long, value string").withColumn("value", seen("value"))
    observed = Observation()
    spec = loadspecs.from_slowlog(df, observed=observed)
    counts = observed.get
    assert counts == {"lines": 9, "parsed": 5, "no_match": 1, "other_log_type": 1, "bad_time": 1, "bad_body": 1}
    assert counts["lines"] == counts["parsed"] + sum(v for k, v in counts.items() if k not in ("lines", "parsed"))
    assert spec.count() == counts["parsed"]
    assert reads.value == len(lines)
    assert loadspecs.from_slowlog(df, max_reject_share=0.4).count() == 5
    with pytest.raises(ValueError, match="3 of 9"):
        loadspecs.from_slowlog(df, max_reject_share=0.2)


def test_indexes_go_round_without_a_sort(spark, tmp_path):
    for file, count in (("a", 60), ("b", 1), ("c", 45)):
        lines = [FULL.replace("08:15:59,041", f"08:{i % 60:02d}:{(i * 7) % 60:02d},{i:03d}") if i % 4 else "junk" for i in range(count)]
        (tmp_path / f"{file}.log").write_text("".join(line + "\n" for line in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    # Files in several splits, and several files in a task.
    for size in ("4000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            lines = readers.read_slowlog(spark, str(tmp_path))
            got = loadspecs.from_slowlog(lines, indexes=["x", "y", "z"], order=readers.LINE_ORDER)
            sorted_ = requests.override_index(requests.replayable(lines), ["x", "y", "z"], readers.LINE_ORDER)
            placed = requests.override_index(requests.replayable(lines), ["x", "y", "z"], block=readers.LINE_ORDER[:2])
            columns = ["file", "block", "line", "index", "_kept"]
            keys = [c for c in columns if c != "_kept"]
            assert sorted(map(tuple, placed.select(keys).collect())) == sorted(map(tuple, sorted_.select(keys).collect()))
            assert "repartitionbyrange" not in placed._jdf.queryExecution().toString().lower()
            assert got.count() == 45 + 0 + 33
            assert {r.u for r in got.selectExpr("split(url, '/')[1] as u").collect()} == {"x", "y", "z"}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
