import json

import pytest
from pyspark.sql import functions as F

from loadlab.functions import documents
from loadlab import session
from loadlab.operators import pseudonyms
from loadlab.session import stage

SCHEMA = """_id long, user string, n long,
 _source struct<user: string, tags: array<string>, deep: struct<mail: string>, list: array<struct<user: string, mail: string>>>,
 extra map<string, string>, groups map<string, struct<user: string>>"""

ROWS = [
    (1, "ann", 5, ("bob", ["ann"], ("ann@x.org",), [("ann", "bob@x.org"), ("cid", None)]), {"user": "dan", "other": "ann"}, {"g": ("eve",)}),
    (2, "bob", 6, (None, None, None, None), None, None),
    (3, None, 7, ("ann ann", [], ("no mail",), []), {}, {}),
]
PATTERNS = {"user": r"(\w+)", "mail": r"(\w+)@"}


def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def expected_map():
    users = {k: str(i) for i, k in enumerate(["ann", "bob", "cid", "dan", "eve"])}
    return {("user", k): v for k, v in users.items()} | {("mail", "ann"): "0", ("mail", "bob"): "1"}


def as_dict(df):
    rows = df.collect()
    assert len({(r.field, r.key) for r in rows}) == len(rows)
    return {(r.field, r.key): r.anon for r in rows}


def test_options(spark):
    patterns = documents.field_patterns
    assert patterns([r"user::(\w+)", r"mail::(\w+)@"]) == PATTERNS
    assert patterns(["a::x(.)y::ignored", "b", "a::(z)"]) == {"a": "(z)", "b": documents.WHOLE_VALUE}
    assert patterns([r"a::(\p{L}+)"]) == {"a": r"(\p{L}+)"}
    assert patterns([r"a::(?P<u_1>\w+)[(?P<x>]\(?P<y>"])["a"] == r"(\w+)[(?P<x>]\(?P<y>"
    for wrong in ("a::.*", "a::(", "a::(?:x)"):
        with pytest.raises(ValueError):
            patterns([wrong])


VALUES = ["line one\nsecret two", "\nall secret", "a\r\nb", "x\u2028y", "\n", "plain", "tail\n"]


@pytest.mark.parametrize("rows", [0, 200_000])
def test_a_bare_field_is_replaced_whole(spark, monkeypatch, rows):
    monkeypatch.setattr(session, "BROADCAST_ROWS", rows)
    whole = documents.field_patterns(["name"])
    df = spark.createDataFrame(list(enumerate(VALUES)), "_id long, name string")
    got = pseudonyms.pseudonymise(df, whole, ["_id"])[0].orderBy("_id").collect()
    assert [r.name for r in got] == [str(i) for i in range(len(VALUES))]
    text = spark.createDataFrame([(i, json.dumps({"name": v})) for i, v in enumerate(VALUES)], "ord long, body string")
    got = pseudonyms.json_pseudonymise(text, whole, ["ord"])[0].orderBy("ord").collect()
    assert [json.loads(r.body)["name"] for r in got] == [str(i) for i in range(len(VALUES))]


@pytest.mark.parametrize("rows", [0, 200_000])
def test_null_order_and_any_number(spark, monkeypatch, rows):
    monkeypatch.setattr(session, "BROADCAST_ROWS", rows)
    df = spark.createDataFrame([(None, "bob"), (1, "ann")], "_id long, user string")
    assert {r.user for r in pseudonyms.pseudonymise(df, PATTERNS, ["_id"])[0].collect()} == {"0", "1"}
    texts = ['{"user":"ann","n":1e400,"m":-1.50E+2,"k":123456789012345678901234567890}', '{"\\u0075ser":"bob"}']
    df = spark.createDataFrame([(None, texts[0]), (2, texts[1])], "ord long, body string")
    one, two = (r.body for r in pseudonyms.json_pseudonymise(df, PATTERNS, ["ord"])[0].orderBy("ord").collect())
    assert '"user":"0"' in one and "1e400" in one and '"user":"1"' in two


def test_map_in_order_of_first_appearance(spark):
    assert as_dict(pseudonyms.build_map(docs(spark), PATTERNS, ["_id"])) == expected_map()


def check_rewritten(df):
    one, two, three = df.orderBy("_id").collect()
    assert (one.user, one.n, one._source.user, one._source.tags) == ("0", 5, "1", ["ann"])
    assert one._source.deep.mail == "0@x.org"
    assert [(i.user, i.mail) for i in one._source.list] == [("0", "1@x.org"), ("2", None)]
    assert one.extra == {"user": "3", "other": "ann"} and one.groups["g"].user == "4"
    assert (two.user, two._source.user, two._source.list, two.extra) == ("1", None, None, None)
    assert (three.user, three._source.user, three._source.deep.mail) == (None, "0 0", "no mail")


def test_rewrite_with_lists(spark):
    rewritten, table = pseudonyms.pseudonymise(docs(spark), PATTERNS, ["_id"])
    check_rewritten(rewritten)
    assert rewritten.schema == docs(spark).schema
    again = pseudonyms.rewrite(docs(spark), PATTERNS, table, ["_id"])
    assert sorted(map(str, again.collect())) == sorted(map(str, rewritten.collect()))


def test_large_dictionary_and_hot_keys(spark, monkeypatch):
    """Nothing is small: hot keys are broadcast, the others shuffled, results are the same."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    for hot in (1_000, 5, 1):
        monkeypatch.setattr(pseudonyms, "HOT_KEYS", hot)
        check_rewritten(pseudonyms.pseudonymise(docs(spark), PATTERNS, ["_id"])[0])


def test_rewrite_in_place(spark, monkeypatch):
    flat = docs(spark).select("_id", "user", F.struct("_source.user", "_source.deep").alias("_source"))
    in_place = pseudonyms.pseudonymise(flat, PATTERNS, ["_id"])[0]
    assert "SortMergeJoin" not in in_place._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    joined = pseudonyms.pseudonymise(flat, PATTERNS, ["_id"])[0]
    assert sorted(map(str, in_place.collect())) == sorted(map(str, joined.collect()))
    assert in_place.schema.simpleString() == joined.schema.simpleString() == flat.schema.simpleString()


def test_known_map_is_kept_and_extended(spark):
    known = spark.createDataFrame([("user", "bob", "7"), ("mail", "zed", "x")], "field string, key string, anon string")
    table = as_dict(pseudonyms.build_map(docs(spark), PATTERNS, ["_id"], known))
    assert table[("user", "bob")] == "7" and table[("mail", "zed")] == "x"
    assert [table[("user", k)] for k in ("ann", "cid", "dan", "eve")] == ["8", "9", "10", "11"]
    assert [table[("mail", k)] for k in ("ann", "bob")] == ["1", "2"]
    whole = stage(pseudonyms.build_map(docs(spark), PATTERNS, ["_id"]), "known")
    assert as_dict(pseudonyms.build_map(docs(spark), PATTERNS, ["_id"], whole)) == expected_map()


BODIES = [
    '{"user":"ann","a":{"user":"bob","n":null},"l":[{"user":"ann x"},"ann",[{"user":"ann"}]],"big":12345678901234567890}',
    '{"user":5,"mail":"ann@x","f":1.50,"t":true}',
    '{"x":"ann"}',
    '{"mail":"none"}',
]


def walk(node, found):
    """Reference walk used only here: strings by field name, through objects and objects in lists."""
    for name, value in node.items():
        if isinstance(value, dict):
            walk(value, found)
        elif isinstance(value, list):
            for item in value:
                if isinstance(item, dict):
                    walk(item, found)
        elif isinstance(value, str) and name in PATTERNS:
            found.append((node, name))
    return found


def test_json_bodies(spark):
    import re

    df = spark.createDataFrame(list(enumerate(BODIES)), "ord long, body string")
    rewritten, table = pseudonyms.json_pseudonymise(df, PATTERNS, ["ord"])
    ids = as_dict(table)
    assert ids == {("user", "ann"): "0", ("user", "bob"): "1", ("mail", "ann"): "0"}
    for row, body in zip(rewritten.orderBy("ord").collect(), BODIES):
        node = json.loads(body)
        for at, name in walk(node, []):
            match = re.search(PATTERNS[name], at[name])
            if match and match.group(1):
                at[name] = at[name].replace(match.group(1), ids[(name, match.group(1))])
        assert json.loads(row.body) == node
    unchanged = rewritten.where("ord >= 2").orderBy("ord").collect()
    assert [r.body for r in unchanged] == BODIES[2:]
