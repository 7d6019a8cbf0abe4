import random
import re

import pytest
from pyspark.sql import functions as F

from loadlab import session
from loadlab.functions import outcomes
from loadlab.operators import attribution, hits, nodes, reports

DOCS = ["The web site, the WEB.", "Web pages", "a site-map of France", "", "Ünïcode straße 42"]
TERMS = ["web", "Web", "Web site", "site map", "nothing", "", "france", "web", "Straße 42", "the"]


def tokens(text):
    return set(re.findall(r"[^\W_]+", text.lower()))


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
@pytest.mark.parametrize("mode", ["term", "match", "match_all"])
def test_hits_against_brute_force(spark, mode, broadcast_rows, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", broadcast_rows)
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    terms = spark.createDataFrame(list(enumerate(TERMS)), "pos long, term string")
    hit = {
        "term": lambda term, doc: term in tokens(doc),
        "match": lambda term, doc: bool(tokens(term) & tokens(doc)),
        "match_all": lambda term, doc: True,
    }[mode]
    expected = [(i, t, sum(hit(t, d) for d in DOCS)) for i, t in enumerate(TERMS)]
    counted = hits.count_hits(docs, terms, mode)
    assert [tuple(r) for r in counted.orderBy("pos").collect()] == expected
    heaviest = [tuple(r) for r in hits.heaviest(counted, 3).collect()]
    assert heaviest == [(t, n) for _, t, n in sorted(expected, key=lambda e: (-e[2], e[0]))[:3]]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_a_document_is_a_row(spark, broadcast_rows, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", broadcast_rows)
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "b"), (None, "b c"), (2, None)], "doc_id long, text string")
    terms = spark.createDataFrame(list(enumerate(["a", "b", "a b", "c x", "d"])), "pos long, term string")
    counted = hits.count_hits(docs, terms, "match").orderBy("pos").collect()
    assert [r.Count for r in counted] == [2, 4, 4, 1, 0]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        hits.count_hits(spark.range(1), spark.range(1), "fuzzy")


def attempts(spark):
    rows = [
        (0, 100, 200, 10, 1500, None),
        (1, 101, 200, 20, 2500, None),
        (2, 103, 503, 0, 0, 1500),
        (3, 104, None, 0, 0, None),
        (4, 112, 429, 0, 0, 500),
        (5, 113, 404, 0, 0, None),
        (6, 119, 500, 0, 0, None),
        (7, 119, 301, 0, 0, None),
        (8, 119, 200, 40, 900, None),
    ]
    return spark.createDataFrame(
        rows, "id long, ts long, code int, took_in_millis long, latency_micros long, pause_millis long"
    )


def rows(df):
    return [tuple(r) for r in df.orderBy("ts").collect()]


def test_reports_are_gap_free(spark):
    a = attempts(spark)
    times = rows(reports.response_time_report(a, 5))
    assert [t[:3] for t in times] == [(105, 2, 15.0), (110, 0, None), (115, 0, None), (120, 1, 40.0)]
    assert times[0][3] == pytest.approx(19.0)
    assert rows(reports.pause_report(a, 5))[0][:3] == (105, 1, 1500.0)
    assert rows(reports.requests_sent_report(a, 5)) == [(105, 4), (110, 4), (115, 6), (120, 9)]
    assert rows(reports.errors_report(a, 5)) == [(105, 1), (110, 1), (115, 2), (120, 4)]
    assert rows(reports.errors_report(a, 5, throttle_codes=(503,)))[-1] == (120, 5)
    assert rows(reports.throughput_report(a, 5))[0] == (105, 0.8, 0.2)


def test_approximate_quantiles_are_close(spark):
    rng = random.Random(5)
    data = [(i, 100 + i % 10, 200, rng.randint(0, 30000)) for i in range(5000)]
    df = spark.createDataFrame(data, "id long, ts long, code int, took_in_millis long")
    exact, approx = (rows(reports.response_time_report(df, 10, approx=flag)) for flag in (False, True))
    for e, a in zip(exact[0][2:], approx[0][2:]):
        assert abs(e - a) <= 100


def test_outcomes(spark):
    codes = {200: "ok", 301: "error", 400: "client_error", 404: "client_error", 429: "throttled", 500: "error", 503: "throttled", None: "transport"}
    df = spark.createDataFrame([(c,) for c in codes], "code int")
    got = {r.code: r.o for r in df.select("code", outcomes.outcome(F.col("code")).alias("o")).collect()}
    assert got == codes
    only = df.select("code", outcomes.outcome(F.col("code"), (503,)).alias("o")).where("code = 429").first()
    assert only.o == "client_error"


def test_response_columns(spark):
    ok, bad = '{"took":7,"hits":{"total":12}}', '{"error":{"type":"parse","reason":"x"},"status":400}'
    row = spark.range(1).select(
        outcomes.took_millis(F.lit(ok)).alias("took"),
        outcomes.hits_total(F.lit(ok)).alias("total"),
        outcomes.error_type(F.lit(bad)).alias("type"),
        outcomes.error_reason(F.lit(bad)).alias("reason"),
        outcomes.latency_micros(F.lit(1999999)).alias("latency"),
        outcomes.retry_after_millis(F.lit("1.2345")).alias("pause"),
        outcomes.retry_after_millis(F.lit("soon")).alias("none"),
    ).first()
    assert tuple(row) == (7, 12, "parse", "x", 1999, 1234, None)


def test_attribution(spark):
    a = attempts(spark)
    requests = attribution.request_rows(a)
    assert requests.count() == 8
    spec = spark.createDataFrame([(i, 0, "u%d" % (i % 2), "s") for i in range(12)], "id long, delay_since_last_nanos long, url string, source string")
    unsent = attribution.unsent(spec, requests)
    assert sorted(r.id for r in unsent.collect()) == [3, 9, 10, 11]
    assert unsent.count() + requests.count() == spec.count()
    by = {r.url: r for r in attribution.latency_by(requests, spec).collect()}
    assert (by["u0"].requests, by["u0"].errors, by["u0"].p50) == (5, 1, 25.0)
    assert (by["u1"].requests, by["u1"].errors, by["u1"].p50) == (3, 2, 20.0)


POLL = """{"_nodes":{"total":2},"nodes":{"n1":{"timestamp":1640995200250,
 "os":{"mem":{"total_in_bytes":8000000,"used_in_bytes":6500000},"swap":{"total_in_bytes":0,"used_in_bytes":0}},
 "process":{"cpu":{"percent":41,"total_in_millis":900}},
 "jvm":{"mem":{"heap_used_in_bytes":5000,"heap_committed_in_bytes":9000,"pools":{"young":{"used_in_bytes":1234,"max_in_bytes":4321}}},
 "gc":{"collectors":{"young":{"collection_count":17,"collection_time_in_millis":260}}}}},
 "n2":{"timestamp":1640995201000}}}"""


def test_node_polls(spark):
    parsed = nodes.parse_polls(spark.createDataFrame([(POLL,)], "body string"))
    young = sorted(tuple(r) for r in nodes.series(parsed, "mem.young").collect())
    assert young == [(1640995200, "n1", 1234, 4321), (1640995201, "n2", None, None)]
    os_mem = nodes.series(parsed, "mem.os")
    assert os_mem.columns == ["poll_ts", "node_id", "used", "total"]
    assert os_mem.where("node_id = 'n1'").first()[2:] == (6500000, 8000000)
    tall = nodes.all_series(parsed)
    assert tall.count() == 40
    assert tall.where("series = 'gc.young' and metric = 'time' and node_id = 'n1'").first().value == 260


def test_unreadable_polls_and_untimed_rows(spark):
    polls = spark.createDataFrame([(POLL,), ("{",), (None,), ('{"nodes":{}}',)], "body string")
    assert sorted(str(r.body) for r in nodes.unreadable_polls(polls).collect()) == ["None", "{", '{"nodes":{}}']
    timed = spark.createDataFrame([(1, 5), (2, None)], "id long, ts long")
    assert [r.id for r in reports.untimed(timed).collect()] == [2]


def test_a_wrong_clock_does_not_stop_a_report(spark):
    far = spark.createDataFrame([(0,), (1_700_000_000,)], "ts long")
    report = reports.counter_report(far, F.lit(True), interval=600)
    last, count = report.agg(F.max("value"), F.count("*")).first()
    assert last == 2 and count == 1_700_000_000 // 600 + 1


def test_gauges_carry_over_ticks_without_poll(spark):
    polls = spark.createDataFrame(
        [(100, "a", 1, 5), (101, "a", 2, None), (117, "a", 3, 7), (109, "b", 9, 9)], "poll_ts long, node_id string, used long, max long"
    )
    report = reports.gauge_report(polls, ["used", "max"], 5, "poll_ts", keys=["node_id"])
    got = [tuple(r) for r in report.orderBy("node_id", "ts").collect()]
    assert got == [("a", 105, 2, 0), ("a", 110, 2, 0), ("a", 115, 2, 0), ("a", 120, 3, 7), ("b", 110, 9, 9)]
