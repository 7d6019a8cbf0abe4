from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loadlab.functions import slowlog
from loadlab.operators import requests
from loadlab.plans import loadspecs

# The two line layouts that occur in practice.
FULL = (
    "[2021-03-02 08:15:59,041][DEBUG][index.search.slowlog.query] [search-7] [orders-2021][3] took[81.7ms], "
    "took_millis[81], types[invoice], stats[], search_type[QUERY_THEN_FETCH], total_shards[12], "
    'source[{"from":20,"query":{"prefix":{"customer":"mill"}}}], extra_source[]'
)
BARE = (
    "[2022-12-31 23:59:58,907][INFO ][index.search.slowlog.query] [] [notes][4] took[6ms], took_millis[6], "
    'types[], stats[], search_type[QUERY_THEN_FETCH], total_shards[1], source[{"query":{"exists":{"field":"tag"}}}], '
    "extra_source[]"
)


def line(ts="2018-11-15 10:57:43,659", kind="query", types="", source="{}", index="test"):
    return (
        f"[{ts}][WARN ][index.search.slowlog.{kind}] [] [{index}][0] took[1ms], took_millis[1], types[{types}], stats[], "
        f"search_type[QUERY_THEN_FETCH], total_shards[5], source[{source}], extra_source[]"
    )


def parse(spark, *lines):
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, value string")
    return [r.asDict() for r in requests.with_url(requests.parse_lines(df)).orderBy("ord").collect()]


def test_full_line(spark):
    (row,) = parse(spark, FULL)
    assert row["ts"] == "2021-03-02 08:15:59,041"
    assert row["log_type"] == "index.search.slowlog.query"
    assert (row["host"], row["index"], row["types"]) == ("search-7", "orders-2021", "invoice")
    assert row["search_type"] == "QUERY_THEN_FETCH"
    assert row["source"] == '{"from":20,"query":{"prefix":{"customer":"mill"}}}'
    assert row["body"] == '{"from":20,"query":{"prefix":{"customer":"mill"}}}'
    assert row["url"] == "search-7/orders-2021/invoice/_search?search_type=query_then_fetch"
    at = datetime(2021, 3, 2, 8, 15, 59, 41000, tzinfo=timezone.utc)
    assert row["ts_nanos"] == int(at.timestamp()) * 10**9 + 41 * 10**6
    assert row["reason"] is None


def test_empty_host_and_types(spark):
    (row,) = parse(spark, BARE)
    assert (row["host"], row["index"], row["types"]) == ("", "notes", "")
    assert row["source"] == '{"query":{"exists":{"field":"tag"}}}'
    assert row["url"] == "/notes//_search?search_type=query_then_fetch"


@pytest.mark.parametrize(
    "ts, fraction",
    [
        ("2018-11-15 10:57:43", 0),
        ("2018-11-15 10:57:43,6", 600_000_000),
        ("2018-11-15 10:57:43.659", 659_000_000),
        ("2018-11-15 10:57:43,123456789", 123_456_789),
        ("2018-11-15 1:57:43,5", None),
        ("2018-11-15T10:57:43,5", "bad"),
        ("2018-11-15", "bad"),
        ("2018-13-15 10:57:43", "bad"),
        ("2018-11-15 10:57:43,1,2", "bad"),
    ],
)
def test_log_times(spark, ts, fraction):
    (row,) = parse(spark, line(ts=ts))
    if fraction == "bad":
        assert row["reason"] == "bad time"
    elif fraction is not None:
        base = int(datetime(2018, 11, 15, 10, 57, 43, tzinfo=timezone.utc).timestamp())
        assert row["ts_nanos"] == base * 10**9 + fraction
    else:
        assert row["reason"] is None


def test_reasons(spark):
    rows = parse(
        spark,
        "junk index.search.slowlog.query types[ stats search_type[ source[ ], extra_source",
        "",
        line(kind="fetch"),
        line(source="[1]"),
        line(source='{"a":1'),
        line(source='{"b":1,"a":2,"a":3}'),
        line(source="null"),
    )
    assert [r["reason"] for r in rows] == ["no match", "no match", "other log type", "bad body", "bad body", None, None]
    assert rows[5]["body"] == '{"a":3,"b":1}'
    assert rows[6]["body"] == "null"


def test_every_line_is_accounted_for(spark):
    lines = [FULL, BARE, "junk", line(kind="fetch"), line(ts="x"), line(source="1")]
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, value string")
    other = requests.parse_lines(df).where("reason = 'other log type'").count()
    assert requests.replayable(df).count() + requests.rejects(df).count() + other == len(lines)
    with pytest.raises(Exception, match="slow-log line rejected"):
        requests.fail_on_reject(requests.parse_lines(df)).collect()


def test_markers_in_the_body_and_large_bodies(spark):
    """Parts matched apart give what the whole pattern gives; brackets stay cheap."""
    from loadlab import fixed_values as fixed

    points = ",".join(f"[{i},{i}]" for i in range(5000))
    lines = [
        line(source='{"q":"types[x] stats search_type[Y] source[z]"}'),
        line(source='{"q":"a source[b], extra_source"}', types="a,b"),
        line(types="a] [b"),
        line(source='{"q":"\x01"}'),
    ]
    for row, text in zip(parse(spark, *lines), lines):
        whole = spark.range(1).select(
            *[F.regexp_extract(F.lit(text), fixed.UNIX_LINES + fixed.SLOWLOG_LINE, i) for i in range(1, 8)]
        ).first()
        assert tuple(row[f] for f in slowlog.FIELDS) == tuple(whole)
    (row,) = parse(spark, line(source='{"p":[' + points + "]}"))
    assert row["body"] == '{"p":[' + points + "]}"


@pytest.mark.parametrize(
    "url, part",
    [
        ("http://localhost:9200/w/_search?x=1", "http://localhost:9200"),
        ("https://h", "https://h"),
        ("h:1/p", "h:1"),
        ("h", "h"),
    ],
)
def test_server_part(url, part):
    assert slowlog.server_part(url) == part


def test_loadspec_order_delays_and_ties(spark):
    lines = [
        line(ts="2018-01-01 00:00:02,000", source='{"n":0}'),
        line(ts="2018-01-01 00:00:01,000", source='{"n":1}'),
        line(ts="2018-01-01 00:00:02,000", source='{"n":2}'),
        line(ts="2018-01-01 00:00:05,500", source='{"n":3}'),
        line(kind="fetch"),
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, value string")
    spec = loadspecs.from_slowlog(df).orderBy("id").collect()
    assert [r.source for r in spec] == ['{"n":1}', '{"n":0}', '{"n":2}', '{"n":3}']
    assert [r.id for r in spec] == [0, 1, 2, 3]
    assert [r.delay_since_last_nanos for r in spec] == [0, 10**9, 0, 35 * 10**8]
    cut = loadspecs.from_slowlog(df, max_duration_seconds=1).orderBy("id").collect()
    assert [r.source for r in cut] == ['{"n":1}', '{"n":0}']
    turned = loadspecs.from_slowlog(df, server="http://s:1/x", indexes=["a", "b"]).orderBy("id").collect()
    assert [r.url.split("/")[3] for r in turned] == ["b", "a", "a", "b"]
    assert turned[0].url == "http://s:1/b//_search?search_type=query_then_fetch"


def test_random_lines_match_as_the_whole_pattern_does(spark):
    """Fields of generated lines, with brackets, markers and any text in them."""
    import json
    import random
    import re

    from loadlab import fixed_values as fixed

    rng = random.Random(42)
    pieces = ["types[", "stats", "search_type[", "source[", "], extra_source", "[", "]", "][", "a", " ", "é", '"', "\\", ",", "1"]
    word = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randint(0, n)))
    lines = []
    for i in range(400):
        body = json.dumps({"q": word(4), "l": [[1, 2], [3]] * rng.randint(0, 2)}, ensure_ascii=False)
        text = line(types=word(2) if rng.random() < 0.3 else "", source=body, index=rng.choice(["a", "b-1", "x]"]))
        if rng.random() < 0.2:
            cut = rng.randint(0, len(text))
            text = text[:cut] + word(3) + text[cut + rng.randint(0, 9):]
        lines.append(text)
    whole = re.compile(fixed.SLOWLOG_LINE)
    for text, row in zip(lines, parse(spark, *lines)):
        match = whole.search(text)
        got = tuple(row[f] for f in slowlog.FIELDS)
        assert got == (match.groups() if match else (None,) * 7), text


def test_canonical_json(spark):
    from loadlab.functions.bodies import canonical_json

    bodies = ['{"b":[{"z":1,"a":null}],"a":{}}', ' {"x": "<&>"} ', "[]", "1", "", None, '{"a":1}x', "{}"]
    bodies += ['{"a":1}]', '{"a":1}}', '{"a":1},{"b":1}', '{"a":1},"k":2', '{"a":1}],[{"b":1}', '{"a":1}},{"b":1}', '{"a":[1]}', "null", "null]"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, b string")
    got = [r.c for r in df.select("i", canonical_json(F.col("b")).alias("c")).orderBy("i").collect()]
    assert got == ['{"a":{},"b":[{"a":null,"z":1}]}', '{"x":"<&>"}', None, None, None, None, None, "{}"] + [None] * 6 + [
        '{"a":[1]}', "null", None
    ]
