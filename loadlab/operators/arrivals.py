"""Synthetic requests: arrival process x query template x dictionary.

An arrival process is a row ``(rate, duration_nanos)``, with any key columns:
one row for one test, many rows for many tests generated together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loadlab import fixed_values as fixed
from loadlab.functions import bodies, draws
from loadlab.operators.sequence import before_block, unfold
from loadlab.session import stage

KINDS = ("const", "poisson")


def process(spark: SparkSession, spec: str, duration_seconds: float) -> tuple[str, DataFrame]:
    """Kind and one-row process from a ``kind:rate`` specification."""
    kind, _, rate = spec.partition(":")
    if kind not in KINDS:
        raise ValueError(f"invalid load type: {kind!r}")
    try:
        value = float(rate)
    except ValueError:
        raise ValueError(f"invalid inter-arrival definition: {spec!r}") from None
    nanos = int(duration_seconds * fixed.NANOS)
    df = spark.range(1).select(F.lit(value).alias("rate"), F.lit(nanos).cast("bigint").alias("duration_nanos"))
    return kind, checked(df, kind)


def checked(processes: DataFrame, kind: str) -> DataFrame:
    """Stop at rates for which arrivals never end: not positive, or a constant
    rate so high that the delay rounds to nothing."""
    wrong = (F.col("rate") <= 0) | F.col("rate").isNull() | F.isnan("rate")
    if kind == "const":
        wrong = wrong | (F.col("rate") > float(fixed.NANOS))
    message = F.concat(F.lit("invalid arrival rate: "), F.coalesce(F.col("rate").cast("string"), F.lit("none")))
    return processes.withColumn("rate", F.when(wrong, F.raise_error(message).cast("double")).otherwise(F.col("rate")))


def constant_arrivals(processes: DataFrame, keys: list[str] = (), block_rows: int | None = None) -> DataFrame:
    """Evenly spaced requests while their time is within the duration."""
    spaced = checked(processes, "const").withColumn("_gap", (F.lit(1e9) / F.col("rate")).cast("bigint"))
    count = F.expr("duration_nanos div _gap") + 1
    rows = unfold(spaced, count, "id", list(keys), block_rows)
    delay = F.when(F.col("id") == 0, F.lit(0).cast("bigint")).otherwise(F.col("_gap"))
    return rows.select(
        *keys, "id", delay.alias("delay_since_last_nanos"), (F.col("id") * F.col("_gap")).alias("at_nanos")
    )


def poisson_arrivals(
    processes: DataFrame, seed: int, keys: list[str] = (), block_rows: int | None = None
) -> DataFrame:
    """Exponential gaps at ``rate`` per second while time is within the duration.

    The draw of a row depends on (seed, keys, id) only.  A few more rows than
    the process needs are drawn (six standard deviations); should that ever be
    too few for some process, all is drawn again with twice the rows.
    """
    keys = list(keys)
    processes = checked(processes, "poisson")
    mean = F.col("rate") * F.col("duration_nanos") / F.lit(1e9)
    spare = 1
    while True:
        count = (F.ceil(mean + 6 * F.sqrt(mean)) + 10).cast("bigint") * spare
        rows = unfold(processes, count, "id", keys, block_rows)
        unit = draws.uniform(seed, *[F.col(k) for k in keys], F.col("id"))
        gap = (-F.ln(F.lit(1.0) - unit) / F.col("rate") * F.lit(1e9)).cast("bigint")
        rows = rows.withColumn("_gap", F.when(F.col("id") == 0, F.lit(0).cast("bigint")).otherwise(gap))
        # One row per process and block.
        totals = stage(
            rows.groupBy(*keys, "_block").agg(
                F.sum("_gap").alias("_total"), F.first("duration_nanos").alias("_limit")
            ),
            "arrival-blocks",
        )
        spans = totals.groupBy(*keys).agg(F.sum("_total").alias("_span"), F.first("_limit").alias("_limit"))
        if spans.where(F.col("_span") <= F.col("_limit")).isEmpty():
            break
        spare *= 2
    before = before_block(totals, "_total", "_before", keys)
    inside = W.partitionBy(*keys, "_block").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    timed = rows.withColumn("_inside", F.sum("_gap").over(inside)).join(before, [*keys, "_block"])
    at = F.col("_before") + F.col("_inside")
    return timed.where(at <= F.col("duration_nanos")).select(
        *keys, "id", F.col("_gap").alias("delay_since_last_nanos"), at.alias("at_nanos")
    )


def arrivals(
    kind: str, processes: DataFrame, seed: int = 0, keys: list[str] = (), block_rows: int | None = None
) -> DataFrame:
    if kind == "const":
        return constant_arrivals(processes, keys, block_rows)
    if kind == "poisson":
        return poisson_arrivals(processes, seed, keys, block_rows)
    raise ValueError(f"invalid load type: {kind!r}")


def sample_terms(requests: DataFrame, dictionary: DataFrame, seed: int, keys: list[str] = ()) -> DataFrame:
    """Each request with a term drawn evenly, with replacement, from a
    dictionary ``(pos, term)`` whose positions are dense.

    Draws spread evenly over positions, so neither side of the join is skewed;
    Spark broadcasts the dictionary if it is below its broadcast threshold.
    """
    first, last, different, size = dictionary.agg(
        F.min("pos"), F.max("pos"), F.count_distinct("pos"), F.count("*")
    ).first()
    if last is None:
        raise ValueError("the query template uses a term but the dictionary is empty")
    if first != 0 or not different == size == last + 1:
        raise ValueError("positions of the dictionary must be 0, 1, 2, ... without gaps, each once")
    drawn = F.pmod(draws.draw_bits(seed, F.lit("term"), *[F.col(k) for k in keys], F.col("id")), F.lit(last + 1))
    return requests.withColumn("_pos", drawn).join(dictionary.select(F.col("pos").alias("_pos"), "term"), "_pos").drop("_pos")


def with_bodies(
    requests: DataFrame,
    template: str,
    url: str,
    dictionary: DataFrame | None = None,
    seed: int = 0,
    keys: list[str] = (),
) -> DataFrame:
    """Loadspec rows: the template filled with a drawn term, the URL as given."""
    if bodies.has_placeholder(template):
        if dictionary is None:
            raise ValueError("the query template uses a term: a dictionary is needed")
        requests = sample_terms(requests, dictionary, seed, keys)
        source = bodies.fill_template(template, F.col("term"))
    else:
        source = F.lit(template)
    return requests.select(*keys, "id", "delay_since_last_nanos", F.lit(url).alias("url"), source.alias("source"))
