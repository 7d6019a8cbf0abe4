import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadlab import session
from loadlab.functions import documents, shapes
from loadlab.operators import pseudonyms, shaped


def patterns():
    return documents.field_patterns(["user", r"mail::([^@]+)@"])


SAME = [
    '{"user":"ann","a":{"user":"bob","n":1},"l":[{"user":"ann x","mail":"z@q"},{"user":"cy"}],"t":["ann"]}',
    '{"user":"dee","l":[]}',
    '{"a":{"n":7}}',
    '{"user":"ann","t":["x","user"]}',
    '{"user":"ünï \\"quoted\\" \\n","a":{"user":"/"}}',
]
ODD = [
    '{"user":null,"a":{"user":"bob"}}',
    '{"user":5,"a":{"user":"eve"}}',
    '{"a":{"user":"fay"},"user":"ann"}',
    '{ "user":"gus"}',
    '{"user":"\\u0061nn"}',
    '{"user":"ann","user":"hal"}',
    '{"user":"ann","a":{"n":1.50}}',
    '{"user":"ann","a":{"n":1e400}}',
    '{"user":"ida","extra":{"user":{"user":"jo"}}}',
    '{"user":"ann","a":{}}',
    None,
]


def run(spark, bodies, way, known=None):
    df = spark.createDataFrame([(i, b, "user") for i, b in enumerate(bodies)], "ord long, body string, user string")
    rows, names = way(df, patterns(), ["ord"], known)
    assert rows.columns == ["ord", "body", "user"]
    return [tuple(r) for r in rows.orderBy("ord").collect()], sorted(map(tuple, names.collect()))


CASES = [
    (0, SAME + ODD, True), (200_000, SAME, False), (200_000, SAME + ODD, True), (200_000, [None], False),
    (200_000, ['{"user":"ann"}', '{"user":{"user":"bob"}}'], False),
]


@pytest.mark.parametrize("rows,bodies,extended", CASES)
def test_both_ways_agree(spark, monkeypatch, rows, bodies, extended):
    monkeypatch.setattr(session, "BROADCAST_ROWS", rows)
    known = spark.createDataFrame([("user", "bob", "7")], "field string, key string, anon string") if extended else None
    assert run(spark, bodies, shaped.pseudonymise_shaped, known) == run(spark, bodies, pseudonyms.json_pseudonymise, known)


def test_agreeing_shapes_stay_in_the_jvm(spark):
    df = spark.createDataFrame(list(enumerate(SAME)), "ord long, body string")
    rows, _ = shaped.pseudonymise_shaped(df, patterns(), ["ord"])
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "pandas" not in plan


def test_shape_in_the_order_of_the_text(spark):
    df = spark.createDataFrame([(SAME[0],), ('{"user":"x","b b":{"v":true}}',), ('["no object"]',), ("junk",)], "body string")
    shape = shapes.common_shape(df)
    assert shape.names == ["user", "a", "l", "t", "b b"] and shape["l"].dataType.elementType.names == ["user", "mail"]
    assert shapes.common_shape(df.where("body = 'junk'")) is None
    rows = df.selectExpr("body").collect()
    assert json.loads(rows[0].body)["user"] == "ann"


def test_long_bodies_go_to_python_in_batches_of_bounded_size(spark):
    @F.pandas_udf("long")
    def together(bodies: pd.Series) -> pd.Series:
        return pd.Series([int(bodies.str.len().sum())] * len(bodies))

    bodies = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("body"))
    most = bodies.select(together("body").alias("n")).agg(F.max("n")).first()[0]
    assert most <= session.BATCH_BYTES + 10_000
