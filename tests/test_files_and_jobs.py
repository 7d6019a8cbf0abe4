import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from loadlab import fixed_values as fixed
from loadlab import session
from loadlab.plans import indexes, loadspecs, reports
from loadlab.sources import readers, writers
from test_hits_and_reports import POLL, attempts
from test_slowlog import BARE, FULL


def read_csv(path):
    lines = []
    for name in sorted(glob.glob(f"{path}/part-*.csv")):
        lines += list(csv.reader(open(name)))
    return lines


def test_slowlog_file_to_loadspec_file(spark, tmp_path):
    (tmp_path / "b.log").write_bytes((FULL + "\r\n" + BARE + "\n").encode())
    (tmp_path / "a.log").write_text(BARE + "\n")
    lines = readers.read_slowlog(spark, str(tmp_path))
    spec = loadspecs.from_slowlog(lines, order=readers.LINE_ORDER)
    writers.write_loadspec(spec, str(tmp_path / "spec"))
    again = readers.read_loadspec(spark, str(tmp_path / "spec")).orderBy("id").collect()
    assert [r.id for r in again] == [0, 1, 2]
    assert [r.url.split("/")[0] for r in again] == ["search-7", "", ""]
    assert again[0].source == '{"from":20,"query":{"prefix":{"customer":"mill"}}}'
    assert again[2].delay_since_last_nanos == 0
    (tmp_path / "bad.json").write_text('{"id":1}\n{"id":\n')
    with pytest.raises(Exception):
        readers.read_loadspec(spark, str(tmp_path / "bad.json")).collect()


def test_lines_of_split_files_stay_in_order(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        terms = readers.read_dictionary(spark, str(tmp_path))
        assert readers.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        assert [r.term for r in terms.orderBy("pos").collect()] == [f"{n}{i}" for n in "xy" for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dictionary_keeps_blank_and_repeated_lines(spark, tmp_path):
    (tmp_path / "d.txt").write_text("web\n\nweb\nWeb site")
    rows = readers.read_dictionary(spark, str(tmp_path / "d.txt")).orderBy("pos").collect()
    assert [(r.pos, r.term) for r in rows] == [(0, "web"), (1, ""), (2, "web"), (3, "Web site")]
    (tmp_path / "e.txt").write_text("")
    assert readers.read_dictionary(spark, str(tmp_path / "e.txt")).count() == 0


def test_report_files(spark, tmp_path):
    (tmp_path / "polls").mkdir()
    (tmp_path / "polls" / "1.json").write_text(POLL)
    polls = readers.read_node_stats(spark, str(tmp_path / "polls"))
    reports.write_reports(attempts(spark), str(tmp_path / "out"), "x7", polls, interval=5)
    names = {p.rsplit("/", 1)[1] for p in glob.glob(str(tmp_path / "out" / "*"))}
    expected = [*fixed.NODE_SERIES, "response.time", "pause.time", "requests.sent", "errors", "request"]
    assert names == {f"{n}_x7.csv" for n in expected}
    times = read_csv(tmp_path / "out" / "response.time_x7.csv")
    assert times[0] == list(fixed.HISTOGRAM_HEADER)
    assert times[1] == ["105", "2", "15.00", "19.00", "19.90", "19.99"]
    assert times[2] == ["110", "0", "NaN", "NaN", "NaN", "NaN"]
    assert read_csv(tmp_path / "out" / "errors_x7.csv")[-1] == ["120", "4"]
    requests = readers.read_requests(spark, str(tmp_path / "out" / "request_x7.csv"))
    assert requests.columns == list(fixed.REQUEST_HEADER) and requests.count() == 8
    with pytest.raises(ValueError):
        reports.write_reports(attempts(spark), "")


def test_hit_count_file(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a"), (2, "b")], "doc_id long, text string")
    terms = spark.createDataFrame([(0, "a"), (1, "b"), (2, "z")], "pos long, term string")
    indexes.hit_counts(docs, terms, path=str(tmp_path / "hits"))
    lines = [json.loads(l) for p in sorted(glob.glob(str(tmp_path / "hits/part-*"))) for l in open(p)]
    assert lines == [{"Term": "b", "Count": 2}, {"Term": "a", "Count": 1}, {"Term": "z", "Count": 0}]


def test_document_slices(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    ids = lambda o, t: sorted(r.k for r in readers.slice_documents(df, ["k"], o, t).collect())
    assert ids(0, 0) == list(range(100))
    assert ids(10, 5) == list(range(10, 15))
    assert ids(95, 0) == list(range(95, 100))
    assert ids(0, 3) == [0, 1, 2]


def test_index_copy_and_its_continuation(spark, tmp_path):
    dump = [{"_id": i, "_source": {"user": f"u{i % 3}", "n": None}} for i in range(6)]
    (tmp_path / "dump.json").write_text("".join(json.dumps(d) + "\n" for d in dump))
    documents = readers.read_documents(spark, str(tmp_path / "dump.json"), total=2)
    run = lambda docs, n, known: indexes.pseudonymise_index(
        docs, ["user"], readers.LINE_ORDER, str(tmp_path / f"out{n}"), str(tmp_path / f"map{n}"), known,
        body="body", dictionary_format="json",
    )
    run(documents, 1, None)
    read = lambda n: [json.loads(l) for p in sorted(glob.glob(str(tmp_path / f"out{n}/part-*"))) for l in open(p)]
    assert sorted(d["_source"]["user"] for d in read(1)) == ["0", "1"]
    known = readers.read_pseudonyms(spark, str(tmp_path / "map1"), "json")
    assert {(r.field, r.key, r.anon) for r in known.collect()} == {("user", "u0", "0"), ("user", "u1", "1")}
    run(readers.read_documents(spark, str(tmp_path / "dump.json"), offset=2), 2, known)
    out = read(2)
    assert [d["_source"] for d in sorted(out, key=lambda d: d["_id"])] == [
        {"user": u, "n": None} for u in ("2", "0", "1", "2")
    ]


def test_pseudonym_files(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame([('a"b', "k\\", "0"), ('a"b', "é", "1"), ("c", "x", "0")], "field string, key string, anon string")
    writers.write_pseudonyms(table, str(tmp_path / "table"))
    writers.write_pseudonyms(table, str(tmp_path / "object"), "json")
    rows = sorted(map(tuple, table.collect()))
    assert sorted(map(tuple, readers.read_pseudonyms(spark, str(tmp_path / "table")).collect())) == rows
    assert sorted(map(tuple, readers.read_pseudonyms(spark, str(tmp_path / "object"), "json").collect())) == rows
    assert readers.read_pseudonyms(spark, "").count() == 0
    with pytest.raises(Exception):
        readers.read_pseudonyms(spark, str(tmp_path / "missing")).count()
    # The parts put together are one JSON object; foreign files may have any layout.
    parts = sorted((tmp_path / "object").glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert whole == {'a"b': {"k\\": "0", "é": "1"}, "c": {"x": "0"}}
    (tmp_path / "foreign.json").write_text(json.dumps(whole, indent=2))
    assert sorted(map(tuple, readers.read_pseudonyms(spark, str(tmp_path / "foreign.json"), "json").collect())) == rows
    writers.write_pseudonyms(table.limit(0), str(tmp_path / "none"), "json")
    assert readers.read_pseudonyms(spark, str(tmp_path / "none"), "json").count() == 0
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    writers.write_pseudonyms(table, str(tmp_path / "object2"), "json")


def test_synthetic_job(spark):
    spec = loadspecs.synthetic(spark, '{"q":1}', "http://h/_search", "const:5", 5).orderBy("id").collect()
    assert len(spec) == 26 and spec[1].delay_since_last_nanos == 200_000_000
    assert spec[0].url == "http://h/_search" and spec[25].source == '{"q":1}'


def test_slices_and_what_a_job_leaves_behind(spark, tmp_path):
    rows = [(i % 3 if i else None, i, json.dumps({"user": f"u{i}"})) for i in range(20)]
    df = spark.createDataFrame(rows, "g long, n long, body string").repartition(3)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))
    for offset, total in ((0, 5), (3, 1), (18, 5), (4, 0), (0, 0), (30, 2)):
        got = readers.slice_documents(df, ["g", "n"], offset, total).collect()
        expected = ordered[offset : offset + total] if total else ordered[offset:]
        assert sorted(r.n for r in got) == sorted(r[1] for r in expected)
    before = set(glob.glob(f"{session._own_dir(spark).removeprefix('file:')}/*"))
    indexes.pseudonymise_index(df, ["user"], ["g", "n"], str(tmp_path / "out"), str(tmp_path / "map"), body="body", dictionary_format="json")
    assert set(glob.glob(f"{session._own_dir(spark).removeprefix('file:')}/*")) == before
    bodies = {json.loads(r.value)["user"] for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert bodies == {str(i) for i in range(20)}
