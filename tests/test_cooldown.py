"""Cooldown against the sequential rule, with blocks small enough to need doubling."""

import random

import pytest

from loadlab.operators import cooldown, sequence


def sequential(delays, pauses):
    """Ids that are sent, one request at a time."""
    sent, remaining = [], 0
    for id, delay in enumerate(delays):
        if remaining > 0:
            remaining -= delay
            continue
        remaining = 0
        sent.append(id)
        if id in pauses:
            remaining = pauses[id]
    return sent


def run(spark, delays, pauses, block_rows):
    spec = spark.createDataFrame(list(enumerate(delays)), "id long, delay_since_last_nanos long")
    asked = spark.createDataFrame(sorted(pauses.items()), "id long, pause_nanos long")
    timed = sequence.schedule(spec, block_rows)
    return [r.id for r in cooldown.kept(timed, asked, block_rows).select("id").orderBy("id").collect()]


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_random_pauses(spark, block_rows):
    rng = random.Random(block_rows)
    delays = [0] + [rng.choice([0, 0, 1, 3, 10]) for _ in range(299)]
    pauses = {i: rng.randint(0, 60) for i in range(300) if rng.random() < 0.4}
    assert run(spark, delays, pauses, block_rows) == sequential(delays, pauses)


def test_every_request_throttled_and_ends_coincide(spark):
    delays = [0] + [1] * 120
    pauses = {i: 150 - i if i % 3 else 4 for i in range(121)}
    assert run(spark, delays, pauses, 5) == sequential(delays, pauses)


def test_no_pause(spark):
    assert run(spark, [0, 5, 5], {1: 0}, 2) == [0, 1, 2]
