import random

import pytest
from pyspark.sql import functions as F

from loadlab.operators import arrivals, sequence


def test_in_order_spreads_one_hot_value(spark):
    """Two thirds of the rows share one time; ids stay dense and tasks share them."""
    rng = random.Random(1)
    rows = [(5 if rng.random() < 0.66 else rng.randint(0, 9), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "t long, ord long").repartition(4)
    out = sequence.in_order(df, ["t", "ord"], previous=["t"]).orderBy("id").collect()
    expected = sorted(rows)
    assert [(r.t, r.ord) for r in out] == expected
    assert [r.id for r in out] == list(range(3000))
    assert [r.previous_t for r in out] == [None, *[t for t, _ in expected[:-1]]]


def test_in_order_many_runs(spark):
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select((F.col("id") * 7 % 13).alias("t"), F.col("id").alias("ord"))
        out = sequence.in_order(df, ["t", "ord"], previous=["t", "ord"])
        assert out.select("id").distinct().count() == 1000
        rows = out.orderBy("id").collect()
        assert [(r.t, r.ord) for r in rows] == sorted((i * 7 % 13, i) for i in range(1000))
        assert all((b.previous_t, b.previous_ord) == (a.t, a.ord) for a, b in zip(rows, rows[1:]))
        plain = sequence.in_order(df, ["t", "ord"]).orderBy("id").collect()
        assert [(r.id, r.ord) for r in plain] == [(r.id, r.ord) for r in rows]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)


def test_empty(spark):
    df = spark.createDataFrame([], "ts_nanos long, ord long")
    assert sequence.arrival_delays(df).count() == 0
    assert sequence.cut_at_duration(df, 5).count() == 0


@pytest.mark.parametrize("block_rows", [3, 100])
def test_running_total_and_carry(spark, block_rows):
    values = [None, 1, None, 4, 5, None, None, 2, 9, None]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    total = sequence.running_total(df.fillna(0), "v", "s", block_rows=block_rows).orderBy("id").collect()
    assert [r.s for r in total] == [0, 1, 1, 5, 10, 10, 10, 12, 21, 21]
    carried = sequence.carry_forward(df, ["v"], "id", block_rows).orderBy("id").collect()
    assert [r.v for r in carried] == [None, 1, 1, 4, 5, 5, 5, 2, 9, 9]


def test_delays_add_up_to_the_span(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 10**6), i) for i in range(500)]
    out = sequence.arrival_delays(spark.createDataFrame(rows, "ts_nanos long, ord long"))
    times = [t for t, _ in rows]
    assert out.agg(F.sum("delay_since_last_nanos")).first()[0] == max(times) - min(times)


def constant_loop(rate, duration):
    gap, now, rows = int(1e9 / rate), 0, []
    while now <= duration:
        rows.append((len(rows), gap if rows else 0, now))
        now += gap
    return rows


@pytest.mark.parametrize("rate, seconds", [(5.0, 5), (3.0, 10), (0.1, 5), (7.3, 1.5)])
def test_constant_arrivals(spark, rate, seconds):
    kind, processes = arrivals.process(spark, f"const:{rate}", seconds)
    rows = arrivals.arrivals(kind, processes, block_rows=4).orderBy("id").collect()
    assert [tuple(r) for r in rows] == constant_loop(rate, int(seconds * 1e9))


def test_poisson_arrivals(spark):
    kind, processes = arrivals.process(spark, "poisson:20", 30)
    small = [tuple(r) for r in arrivals.arrivals(kind, processes, 11, block_rows=50).orderBy("id").collect()]
    large = [tuple(r) for r in arrivals.arrivals(kind, processes, 11).orderBy("id").collect()]
    assert small == large
    now = 0
    for position, (id, delay, at) in enumerate(small):
        now += delay
        assert (id, at) == (position, now)
    assert small[0][1:] == (0, 0) and now <= 30 * 10**9
    assert 450 < len(small) < 750


def test_poisson_draws_more_rows_when_short(spark):
    """A mean far below the six-deviation margin still reaches the end."""
    processes = spark.createDataFrame([("a", 0.001, 10**9), ("b", 50.0, 10**10)], "test string, rate double, duration_nanos long")
    rows = arrivals.arrivals("poisson", processes, 5, ["test"]).collect()
    assert [r.id for r in rows if r.test == "a"] == [0]
    assert sorted(r.id for r in rows if r.test == "b") == list(range(sum(r.test == "b" for r in rows)))


@pytest.mark.parametrize("spec", ["const", "const:x", "ramp:5", ""])
def test_bad_arrival_specs(spark, spec):
    with pytest.raises(ValueError):
        arrivals.process(spark, spec, 1)


@pytest.mark.parametrize("spec", ["const:0", "poisson:-1", "const:2e9"])
def test_rates_that_never_end(spark, spec):
    kind, processes = arrivals.process(spark, spec, 1)
    with pytest.raises(Exception, match="invalid arrival rate"):
        arrivals.arrivals(kind, processes).collect()


def test_bodies(spark):
    _, processes = arrivals.process(spark, "const:10", 1)
    timed = arrivals.constant_arrivals(processes)
    terms = spark.createDataFrame([(0, "a $1 \\ b"), (1, ""), (2, "c")], "pos long, term string")
    rows = arrivals.with_bodies(timed, '{"x":"$RDICT","y":"$RDICT"}', "u", terms, 3).collect()
    assert {r.source for r in rows} <= {'{"x":"%s","y":"$RDICT"}' % t for t in ("a $1 \\ b", "", "c")}
    assert len(rows) == 11 and {r.url for r in rows} == {"u"}
    assert {r.source for r in arrivals.with_bodies(timed, "{}", "u").collect()} == {"{}"}
    with pytest.raises(ValueError):
        arrivals.with_bodies(timed, "$RDICT", "u")
    with pytest.raises(ValueError):
        arrivals.with_bodies(timed, "$RDICT", "u", terms.limit(0))


def test_two_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BLOCKS_PER_GROUP", 3)
    rows = [(k, i, (i * 7 + k) % 11) for k in (0, 1) for i in range(25)]
    df = spark.createDataFrame(rows, "k long, _block long, v long")
    sums = {(r.k, r._block): r.s for r in sequence.before_block(df, "v", "s", ["k"]).collect()}
    most = {(r.k, r._block): r.m for r in sequence.before_block(df, "v", "m", ["k"], fold=F.max).collect()}
    for k, i, _ in rows:
        before = [v for a, b, v in rows if a == k and b < i]
        assert sums[k, i] == sum(before) and most[k, i] == max(before, default=None)
    unfolded = sequence.unfold(df.select("k").distinct(), F.lit(100), "p", ["k"], block_rows=4).collect()
    assert sorted((r.k, r.p) for r in unfolded) == [(k, p) for k in (0, 1) for p in range(100)]
    assert all(r._block == r.p // 4 for r in unfolded)


def test_dictionary_positions_must_be_dense(spark):
    requests = spark.range(10)
    dense = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, term string")
    assert arrivals.sample_terms(requests, dense, 1).count() == 10
    for gapped in ([(0, "a"), (2, "b")], [(1, "a")], [(0, "a"), (0, "b")]):
        with pytest.raises(ValueError):
            arrivals.sample_terms(requests, spark.createDataFrame(gapped, "pos long, term string"), 1)
