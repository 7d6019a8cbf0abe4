"""Registered queries and the SQL that checks them, next to each other.

``query(name, sql)`` registers a Spark callable together with independent SQL
over the given tables.  The SQL never reads what Spark rendered; it derives the
expected rows straight from the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from loadlab import fixed_values as fixed
from loadlab.functions import documents, outcomes
from loadlab.operators import (
    arrivals, attribution, cooldown, hits, inverted, nodes, pseudonyms, reports, requests, sequence, shaped, sketches
)
from loadlab.plans import given_tables as given, indexes, loadspecs, reports as reports_job
from loadlab.sources import bucketed, readers, writers
from loadlab.session import new_folder, prepare, stage
from loadlab.streaming import attribution as attribution_stream, batches, delays, late, loadspec as loadspec_stream, ordered, slowlog as slowlog_stream, ticks
from loadlab.streaming.pseudonyms import stream_pseudonymise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(prepare(spark), sf_dir)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# --- slow log ---------------------------------------------------------------

LOG = """
log AS (
  SELECT event_id, event_type, user_id, value,
         regexp_extract(props, '[0-9]+') AS k,
         epoch_us(ts) // 1000 * 1000000 AS ts_nanos,
         'host' || (user_id % 3) AS host,
         CASE WHEN value >= 50 THEN 'doc' ELSE '' END AS types,
         CASE WHEN value >= 100 THEN 'dfs_query_then_fetch' ELSE 'query_then_fetch' END AS search_type,
         '{"preference":"user-' || user_id || '","query":{"term":{"k":' || regexp_extract(props, '[0-9]+') || '}},"size":' || user_id || '}' AS body
  FROM events
  WHERE event_type <> 'signup' AND NOT (event_type = 'error' AND (value >= 200 OR value < 5))
)"""

SPEC = LOG + """,
spec AS (
  SELECT event_id, ts_nanos,
         row_number() OVER (ORDER BY ts_nanos, event_id) - 1 AS id,
         coalesce(ts_nanos - lag(ts_nanos) OVER (ORDER BY ts_nanos, event_id), 0) AS delay_since_last_nanos,
         host || '/' || event_type || '/' || types || '/_search?search_type=' || search_type AS url,
         body AS source
  FROM log
)"""


@query(
    "slowlog_parse",
    f"""WITH {LOG}
    SELECT event_id AS ord, ts_nanos, 'index.search.slowlog.query' AS log_type, host, event_type AS "index", types,
           upper(search_type) AS search_type, body,
           host || '/' || event_type || '/' || types || '/_search?search_type=' || search_type AS url
    FROM log""",
)
def slowlog_parse(spark, sf_dir):
    parsed = requests.with_url(requests.replayable(given.slowlog_lines(spark, sf_dir)))
    return parsed.select("ord", "ts_nanos", "log_type", "host", "index", "types", "search_type", "body", "url")


@query(
    "slowlog_rejects",
    """SELECT event_id AS ord, CASE WHEN value >= 200 THEN 'bad time' ELSE 'bad body' END AS reason
    FROM events WHERE event_type = 'error' AND (value >= 200 OR value < 5)""",
)
def slowlog_rejects(spark, sf_dir):
    return requests.rejects(given.slowlog_lines(spark, sf_dir)).select("ord", "reason")


@query(
    "slowlog_counts",
    """WITH kinds AS (
      SELECT event_type = 'signup' AS other, event_type = 'error' AND value >= 200 AS bad_time, event_type = 'error' AND value < 5 AS bad_body FROM events)
    SELECT count(*) AS lines, count(*) FILTER (NOT other AND NOT bad_time AND NOT bad_body) AS parsed, CAST(0 AS BIGINT) AS no_match,
           count(*) FILTER (other) AS other_log_type, count(*) FILTER (NOT other AND bad_time) AS bad_time,
           count(*) FILTER (NOT other AND NOT bad_time AND bad_body) AS bad_body,
           count(*) FILTER (NOT other AND NOT bad_time AND NOT bad_body) AS requests
    FROM kinds""",
)
def slowlog_counts(spark, sf_dir):
    """What became of the lines of a log, counted while the loadspec was made."""
    observed = Observation()
    spec = loadspecs.from_slowlog(given.slowlog_lines(spark, sf_dir), observed=observed, max_reject_share=0.5)
    counts = [F.lit(observed.get[c]).cast("bigint").alias(c) for c in ("lines", "parsed", *requests.REASONS.values())]
    return spec.agg(F.count("*").alias("requests")).select(*counts, "requests")


@query("loadspec_from_log", f"WITH {SPEC} SELECT id, delay_since_last_nanos, url, source FROM spec")
def loadspec_from_log(spark, sf_dir):
    return loadspecs.from_slowlog(given.slowlog_lines(spark, sf_dir)).select(*loadspecs.COLUMNS)


@query(
    "loadspec_max_duration",
    f"""WITH {SPEC}, elapsed AS (
      SELECT *, ts_nanos - delay_since_last_nanos - first_value(ts_nanos) OVER (ORDER BY id) AS before FROM spec)
    SELECT id, delay_since_last_nanos, url, source FROM elapsed WHERE id = 0 OR before < 86400000000000""",
)
def loadspec_max_duration(spark, sf_dir):
    lines = given.slowlog_lines(spark, sf_dir)
    return loadspecs.from_slowlog(lines, max_duration_seconds=86_400).select(*loadspecs.COLUMNS)


@query(
    "loadspec_overrides",
    f"""WITH {LOG}, kept AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM log)
    SELECT row_number() OVER (ORDER BY ts_nanos, event_id) - 1 AS id,
           coalesce(ts_nanos - lag(ts_nanos) OVER (ORDER BY ts_nanos, event_id), 0) AS delay_since_last_nanos,
           'http://localhost:9200/' || (['a','b','c'])[(n % 3 + 1)::INT] || '/' || types
             || '/_search?search_type=' || search_type AS url,
           body AS source
    FROM kept""",
)
def loadspec_overrides(spark, sf_dir):
    spec = loadspecs.from_slowlog(
        given.slowlog_lines(spark, sf_dir), server="http://localhost:9200/x/_search", indexes=["a", "b", "c"]
    )
    return spec.select(*loadspecs.COLUMNS)


@query(
    "test_duration",
    f"""WITH {SPEC} SELECT CAST(max(ts_nanos) - min(ts_nanos) AS BIGINT) AS duration_nanos, count(*) AS requests FROM spec""",
)
def test_duration(spark, sf_dir):
    return loadspecs.duration_nanos(loadspecs.from_slowlog(given.slowlog_lines(spark, sf_dir)))


@query(
    "schedule_times",
    f"""WITH {SPEC} SELECT id, CAST(sum(delay_since_last_nanos) OVER (ORDER BY id) AS BIGINT) AS at_nanos FROM spec""",
)
def schedule_times(spark, sf_dir):
    spec = loadspecs.from_slowlog(given.slowlog_lines(spark, sf_dir))
    return sequence.schedule(stage(spec, "loadspec")).select("id", "at_nanos")


# --- synthetic load ---------------------------------------------------------

PROCESSES = """
processes AS (
  SELECT event_type AS test,
         CAST(count(*) AS DOUBLE) / 2592000 AS rate,
         CAST(2592000000000000 AS BIGINT) AS duration_nanos
  FROM events GROUP BY event_type
)"""


def observed_processes(spark, sf_dir):
    """One arrival process per event type, at the rate seen over thirty days."""
    events = given.table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("test")).agg(
        (F.count("*").cast("double") / 2_592_000).alias("rate"),
        F.lit(2_592_000 * fixed.NANOS).cast("bigint").alias("duration_nanos"),
    )


@query(
    "arrivals_const",
    f"""WITH {PROCESSES}, gaps AS (SELECT *, CAST(trunc(1e9 / rate) AS BIGINT) AS gap FROM processes)
    SELECT test, id, CASE WHEN id = 0 THEN 0 ELSE gap END AS delay_since_last_nanos, id * gap AS at_nanos
    FROM gaps, unnest(range(0, duration_nanos // gap + 1)) AS r(id)""",
)
def arrivals_const(spark, sf_dir):
    return arrivals.arrivals("const", observed_processes(spark, sf_dir), keys=["test"])


POISSON = PROCESSES + """,
drawn AS (
  SELECT test, rate, duration_nanos, id,
         ('0x' || substr(md5('7:' || test || ':' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM processes, unnest(range(0, CAST(2 * rate * 2592000 + 200 AS BIGINT))) AS r(id)
),
gapped AS (
  SELECT test, id, duration_nanos,
         CASE WHEN id = 0 THEN 0 ELSE CAST(trunc(-ln(1.0::DOUBLE - u) / rate * 1e9) AS BIGINT) END AS delay_since_last_nanos
  FROM drawn
),
timed AS (
  SELECT *, CAST(sum(delay_since_last_nanos) OVER (PARTITION BY test ORDER BY id) AS BIGINT) AS at_nanos FROM gapped
)"""


@query(
    "arrivals_poisson",
    f"WITH {POISSON} SELECT test, id, delay_since_last_nanos, at_nanos FROM timed WHERE at_nanos <= duration_nanos",
)
def arrivals_poisson(spark, sf_dir):
    return arrivals.arrivals("poisson", observed_processes(spark, sf_dir), seed=7, keys=["test"])


DICTIONARY = r"""
turns AS (SELECT conv_id, turn, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '[ \n]') AS words FROM conversations),
parts AS (
  SELECT conv_id, turn, 0 AS part, i, lines[i] AS term FROM turns, unnest(range(1, len(lines) + 1)) AS t(i)
  UNION ALL
  SELECT conv_id, turn, 1, min(i), words[i] FROM turns, unnest(range(1, len(words) + 1)) AS t(i) GROUP BY conv_id, turn, words[i]),
dictionary AS (SELECT row_number() OVER (ORDER BY conv_id, turn, part, i) - 1 AS pos, term FROM parts)"""


@query(
    "synthetic_loadspec",
    f"""WITH {DICTIONARY}, {POISSON}, size AS (SELECT count(*) AS n FROM dictionary)
    SELECT test, id, delay_since_last_nanos, 'http://localhost:9200/w/_search' AS url,
           '{{"query": {{"term": {{"text": {{"value": "' || term || '"}}}}}}, "note": "$RDICT"}}' AS source
    FROM timed, size, dictionary
    WHERE at_nanos <= duration_nanos
      AND pos = ('0x' || substr(md5('7:term:' || test || ':' || id), 1, 13))::BIGINT % n""",
)
def synthetic_loadspec(spark, sf_dir):
    timed = arrivals.arrivals("poisson", observed_processes(spark, sf_dir), seed=7, keys=["test"])
    template = '{"query": {"term": {"text": {"value": "$RDICT"}}}, "note": "$RDICT"}'
    return arrivals.with_bodies(
        timed, template, "http://localhost:9200/w/_search", given.dictionary(spark, sf_dir), seed=7, keys=["test"]
    )


# --- hit counts -------------------------------------------------------------

TOKENS = r"""
tokens AS (
  SELECT DISTINCT doc_id, token FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents)
  WHERE token <> '')"""


@query("dictionary", f"WITH {DICTIONARY} SELECT pos, term FROM dictionary")
def dictionary(spark, sf_dir):
    return given.dictionary(spark, sf_dir)


@query(
    "term_hits",
    f"""WITH {DICTIONARY}, {TOKENS}, df AS (SELECT token, count(*) AS n FROM tokens GROUP BY token)
    SELECT pos, term AS "Term", coalesce(n, 0) AS "Count" FROM dictionary LEFT JOIN df ON token = term""",
)
def term_hits(spark, sf_dir):
    return hits.count_hits(given.documents(spark, sf_dir), given.dictionary(spark, sf_dir), "term")


MATCH = DICTIONARY + "," + TOKENS + r""",
lines AS (
  SELECT pos, unnest(regexp_split_to_array(lower(term), '[^\p{L}\p{N}]+')) AS token FROM dictionary),
found AS (
  SELECT pos, count(DISTINCT doc_id) AS n FROM lines JOIN tokens USING (token) WHERE token <> '' GROUP BY pos),
hits AS (SELECT pos, term AS "Term", coalesce(n, 0) AS "Count" FROM dictionary LEFT JOIN found USING (pos))"""


@query("match_hits", f'WITH {MATCH} SELECT pos, "Term", "Count" FROM hits')
def match_hits(spark, sf_dir):
    return hits.count_hits(given.documents(spark, sf_dir), given.dictionary(spark, sf_dir), "match")


@query("heaviest_terms", f'WITH {MATCH} SELECT "Term", "Count" FROM hits ORDER BY "Count" DESC, pos LIMIT 20')
def heaviest_terms(spark, sf_dir):
    counted = hits.count_hits(given.documents(spark, sf_dir), given.dictionary(spark, sf_dir), "match")
    return hits.heaviest(counted, 20)


@query("indexed_hits", f'WITH {MATCH} SELECT pos, "Term", "Count" FROM hits')
def indexed_hits(spark, sf_dir):
    """Answered by an index that is written in two parts, the second one when more documents come."""
    folder = new_folder(spark, "index")
    docs = given.documents(spark, sf_dir)
    for part in range(2):
        inverted.write_index(docs.where(F.pmod("doc_id", F.lit(2)) == part), folder, part=part)
    return hits.indexed_hits(inverted.read_index(spark, folder), given.dictionary(spark, sf_dir))


# --- reports ----------------------------------------------------------------

ATTEMPTS = """
attempts AS (
  SELECT event_id AS id, epoch_us(ts) // 1000000 AS ts,
         CASE WHEN event_type = 'error' THEN
                CASE user_id % 5 WHEN 0 THEN 503 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 301 END
              WHEN CAST(regexp_extract(props, '[0-9]+') AS INT) < 3 THEN 404 ELSE 200 END AS code,
         CAST(floor(value) AS BIGINT) AS took, CAST(floor(value * 1000) AS BIGINT) + 150 AS latency,
         (user_id % 7) * 1000 + 500 AS pause
  FROM events
),
judged AS (
  SELECT *, (epoch_tick // 600 + 1) * 600 AS tick, CASE WHEN code IS NULL THEN 'transport' WHEN code = 200 THEN 'ok'
    WHEN code IN (429, 503) THEN 'throttled' WHEN code BETWEEN 400 AND 499 THEN 'client_error' ELSE 'error' END AS outcome
  FROM (SELECT *, ts AS epoch_tick FROM attempts)
),
spine AS (
  SELECT unnest(range(min(tick), max(tick) + 1, 600)) AS ts FROM judged
)"""
TICK = 600


def histogram_sql(value: str, condition: str) -> str:
    return f"""WITH {ATTEMPTS}, q AS (
      SELECT tick, count(*) AS n, quantile_cont({value}, [0.5, 0.9, 0.99, 0.999]) AS v
      FROM judged WHERE {condition} GROUP BY tick)
    SELECT ts, coalesce(n, 0) AS "count", round(v[1], 6) AS p50, round(v[2], 6) AS p90,
           round(v[3], 6) AS p99, round(v[4], 6) AS p999
    FROM spine LEFT JOIN q ON tick = ts"""


def counter_sql(condition: str) -> str:
    return f"""WITH {ATTEMPTS}, per_tick AS (SELECT tick, count(*) AS n FROM judged WHERE {condition} GROUP BY tick)
    SELECT ts, CAST(sum(coalesce(n, 0)) OVER (ORDER BY ts) AS BIGINT) AS "value" FROM spine LEFT JOIN per_tick ON tick = ts"""


def rounded(report: DataFrame) -> DataFrame:
    return report.select("ts", "count", *[F.round(q, 6).alias(q) for q in fixed.QUANTILE_NAMES])


@query("latency_report", histogram_sql("took", "code = 200"))
def latency_report(spark, sf_dir):
    return rounded(reports.response_time_report(given.attempts(spark, sf_dir), TICK))


def rollup_sql(rows: str, levels: str) -> str:
    """Quantiles of stored ticks: exact up to the size of a sketch, and none with a rank farther off than it may be."""
    few = f"count(v) BETWEEN 1 AND {sketches.SIZE}"
    exact = ", ".join(
        f"CASE WHEN {few} THEN quantile_disc(v, {q}) END AS {name}" for q, name in zip(fixed.QUANTILES, fixed.QUANTILE_NAMES)
    )
    return f"""WITH {rows}, levels AS ({levels})
    SELECT level, ts, count(v) AS "count", count(v) <= {sketches.SIZE} AS exact, {exact}, CAST(0 AS BIGINT) AS outside
    FROM levels GROUP BY level, ts"""


def rolled_up(levels: dict[str, tuple[DataFrame, int]], rows: DataFrame, value) -> DataFrame:
    parts = []
    for level, (ticked, interval) in levels.items():
        wrong = sketches.outside(ticked, rows, value, interval)
        found = sketches.quantiles(ticked).join(wrong, "ts", "left")
        shown = [F.when(F.col("exact"), F.col(q)).alias(q) for q in fixed.QUANTILE_NAMES]
        outside = F.coalesce("outside", F.lit(0)).alias("outside")
        parts.append(found.select(F.lit(level).alias("level"), "ts", "count", "exact", *shown, outside))
    return reduce(DataFrame.unionByName, parts)


@query(
    "latency_rollup",
    rollup_sql(
        ATTEMPTS,
        """SELECT 'tick' AS level, tick AS ts, CASE WHEN code = 200 THEN took END AS v FROM judged
           UNION ALL SELECT 'day', (ts // 86400 + 1) * 86400, CASE WHEN code = 200 THEN took END FROM judged""",
    ),
)
def latency_rollup(spark, sf_dir):
    """Ticks stored as sketches, merged to days."""
    attempts, took = given.attempts(spark, sf_dir), F.when(F.col("code") == 200, F.col("took_in_millis"))
    stored = stage(sketches.tick_sketches(attempts, took, TICK), "stored-ticks")
    return rolled_up({"tick": (stored, TICK), "day": (sketches.merged(stored, 86_400), 86_400)}, attempts, took)


@query("pause_report", histogram_sql("pause", "outcome = 'throttled'"))
def pause_report(spark, sf_dir):
    return rounded(reports.pause_report(given.attempts(spark, sf_dir), TICK))


@query("requests_sent_report", counter_sql("TRUE"))
def requests_sent_report(spark, sf_dir):
    return reports.requests_sent_report(given.attempts(spark, sf_dir), TICK)


@query("errors_report", counter_sql("outcome IN ('transport', 'client_error', 'error')"))
def errors_report(spark, sf_dir):
    return reports.errors_report(given.attempts(spark, sf_dir), TICK)


@query(
    "throughput_report",
    f"""WITH {ATTEMPTS}, per_tick AS (
      SELECT tick, count(*) AS n, count(*) FILTER (outcome IN ('transport', 'client_error', 'error')) AS e
      FROM judged GROUP BY tick)
    SELECT ts, round(coalesce(n, 0) / 600.0::DOUBLE, 9) AS requests_per_sec, round(coalesce(e, 0) / 600.0::DOUBLE, 9) AS errors_per_sec
    FROM spine LEFT JOIN per_tick ON tick = ts""",
)
def throughput_report(spark, sf_dir):
    report = reports.throughput_report(given.attempts(spark, sf_dir), TICK)
    return report.select("ts", *[F.round(c, 9).alias(c) for c in ("requests_per_sec", "errors_per_sec")])


@query("status_summary", f"WITH {ATTEMPTS} SELECT code, outcome, count(*) AS requests FROM judged GROUP BY code, outcome")
def status_summary(spark, sf_dir):
    return reports.status_summary(given.attempts(spark, sf_dir))


@query(
    "gauge_report",
    f"""WITH {ATTEMPTS}, newest AS (
      SELECT tick, last(took ORDER BY ts, id) AS used, last(latency ORDER BY ts, id) AS "max" FROM judged GROUP BY tick)
    SELECT s.ts, coalesce(last_value(used IGNORE NULLS) OVER w, 0) AS used, coalesce(last_value("max" IGNORE NULLS) OVER w, 0) AS "max"
    FROM spine s LEFT JOIN newest ON tick = s.ts
    WINDOW w AS (ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def gauge_report(spark, sf_dir):
    polls = given.attempts(spark, sf_dir).select(
        "ts", "id", F.col("took_in_millis").alias("used"), F.col("latency_micros").alias("max")
    )
    return reports.gauge_report(polls, ["used", "max"], TICK, newest=F.struct("ts", "id"))


# --- pseudonyms -------------------------------------------------------------

PAGE_OPTIONS = [r"url::https?://([^/]+)", "lang"]

# Members of a page in schema order: url, _source.url, _source.lang, links[0].url.
PAGES = r"""
found AS (
  SELECT page_id, url, regexp_extract(url, 'https?://([^/]+)', 1) AS host,
         regexp_extract(html, 'lang="([^"]+)"', 1) AS lang, length(html) AS size
  FROM pages
),
members AS (
  SELECT 'url' AS field, host AS "key", page_id, 0 AS place FROM found WHERE host <> ''
  UNION ALL SELECT 'lang', lang, page_id, 2 FROM found WHERE lang <> ''
),
firsts AS (SELECT field, "key", min(page_id * 10 + place) AS first FROM members GROUP BY field, "key"),
ids AS (
  SELECT field, "key", CAST(row_number() OVER (PARTITION BY field ORDER BY first) - 1 AS VARCHAR) AS anon FROM firsts
)"""


def page_patterns():
    return documents.field_patterns(PAGE_OPTIONS)


@query("pseudonym_map", f'WITH {PAGES} SELECT field, "key", anon FROM ids')
def pseudonym_map(spark, sf_dir):
    return pseudonyms.build_map(given.page_documents(spark, sf_dir), page_patterns(), ["_id"])


@query("keys_per_field", f"WITH {PAGES} SELECT field, count(*) AS keys FROM ids GROUP BY field")
def keys_per_field(spark, sf_dir):
    return pseudonyms.keys_per_field(pseudonym_map(spark, sf_dir))


def page_columns(pages: DataFrame) -> DataFrame:
    return pages.select(
        "_id",
        "url",
        F.col("_source.url").alias("source_url"),
        F.col("_source.lang").alias("source_lang"),
        F.col("_source.size").cast("bigint").alias("source_size"),
    )


SWAPPED = """
    FROM found
    LEFT JOIN ids h ON h.field = 'url' AND h."key" = host
    LEFT JOIN ids l ON l.field = 'lang' AND l."key" = lang"""


@query(
    "pseudonymised_pages",
    f"""WITH {PAGES}
    SELECT page_id AS _id, coalesce(replace(url, host, h.anon), url) AS url,
           coalesce(replace(url, host, h.anon), url) AS source_url,
           coalesce(replace(lang, lang, l.anon), lang) AS source_lang, size AS source_size {SWAPPED}""",
)
def pseudonymised_pages(spark, sf_dir):
    """Fields at the top and in an object only: documents stay where they are."""
    pages = given.page_documents(spark, sf_dir).drop("links")
    return page_columns(pseudonyms.pseudonymise(pages, page_patterns(), ["_id"])[0])


@query(
    "pseudonymised_links",
    f"""WITH {PAGES}
    SELECT page_id AS _id, coalesce(replace(url, host, h.anon), url) AS url,
           coalesce(replace(url || '#top', host, h.anon), url || '#top') AS link, 'mailto:x' AS other_link {SWAPPED}""",
)
def pseudonymised_links(spark, sf_dir):
    """A field in a list of objects as well: documents are joined by their id."""
    rewritten, _ = pseudonyms.pseudonymise(given.page_documents(spark, sf_dir), page_patterns(), ["_id"])
    return rewritten.select(
        "_id", "url", F.col("links")[0]["url"].alias("link"), F.col("links")[1]["url"].alias("other_link")
    )


@query(
    "pseudonym_map_extended",
    f"""WITH {PAGES},
    first_run AS (
      SELECT m.field, m."key", min(m.page_id * 10 + m.place) AS first
      FROM members m JOIN found USING (page_id) WHERE lang = 'en' GROUP BY m.field, m."key"),
    ranked AS (
      SELECT f.field, f."key", row_number() OVER (PARTITION BY f.field ORDER BY r.first IS NULL, r.first, f.first) - 1 AS n
      FROM firsts f LEFT JOIN first_run r ON r.field = f.field AND r."key" = f."key")
    SELECT field, "key", CAST(n AS VARCHAR) AS anon FROM ranked""",
)
def pseudonym_map_extended(spark, sf_dir):
    """The English pages first, then all pages with that dictionary known."""
    pages = given.page_documents(spark, sf_dir)
    known = stage(pseudonyms.build_map(pages.where("_source.lang = 'en'"), page_patterns(), ["_id"]), "known")
    return pseudonyms.build_map(pages, page_patterns(), ["_id"], known)


@query(
    "pseudonymised_requests",
    f"""WITH {LOG},
    firsts AS (SELECT user_id, min(event_id) AS first FROM log GROUP BY user_id),
    ids AS (SELECT user_id, row_number() OVER (ORDER BY first) - 1 AS anon FROM firsts)
    SELECT row_number() OVER (ORDER BY ts_nanos, event_id) - 1 AS id,
           coalesce(ts_nanos - lag(ts_nanos) OVER (ORDER BY ts_nanos, event_id), 0) AS delay_since_last_nanos,
           host || '/' || event_type || '/' || types || '/_search?search_type=' || search_type AS url,
           '{{"preference":"user-' || anon || '","query":{{"term":{{"k":' || k || '}}}},"size":' || user_id || '}}' AS source
    FROM log JOIN ids USING (user_id)""",
)
def pseudonymised_requests(spark, sf_dir):
    patterns = documents.field_patterns([r"preference::user-(\d+)"])
    spec = loadspecs.from_slowlog(
        given.slowlog_lines(spark, sf_dir),
        pseudonymise=lambda rows: shaped.pseudonymise_shaped(rows, patterns, ["ord"])[0],
    )
    return spec.select(*loadspecs.COLUMNS)


# --- requests against the loadspec ------------------------------------------

JOINED = f"WITH {SPEC}," + ATTEMPTS.replace("SELECT event_id AS id", "SELECT event_id") + """,
sent AS (
  SELECT s.id, s.url, s.source, j.ts, j.code, j.outcome,
         CASE WHEN j.code = 200 THEN took ELSE 0 END AS took_in_millis,
         CASE WHEN j.code = 200 THEN latency ELSE 0 END AS latency_micros
  FROM spec s JOIN judged j USING (event_id))"""


def replayed(spark, sf_dir):
    """A loadspec and what came back for each of its entries."""
    spec = loadspecs.from_slowlog(given.slowlog_lines(spark, sf_dir))
    came_back = given.attempts(spark, sf_dir).withColumnRenamed("id", "ord")
    return spec, came_back.join(spec.select("ord", "id"), "ord").drop("ord")


@query(
    "request_attribution",
    JOINED + """ SELECT id, ts, code, took_in_millis, latency_micros, url, source FROM sent WHERE code IS NOT NULL""",
)
def request_attribution(spark, sf_dir):
    spec, attempts = replayed(spark, sf_dir)
    return attribution.attribute(attribution.request_rows(attempts), spec)


@query(
    "attribution_bucketed",
    JOINED + """ SELECT id, ts, code, took_in_millis, latency_micros, url, source FROM sent WHERE code IS NOT NULL""",
)
def attribution_bucketed(spark, sf_dir):
    """The same from tables kept in buckets of the id: bucket joins bucket."""
    spec, attempts = replayed(spark, sf_dir)
    folder = new_folder(spark, "buckets")
    name = "t" + folder.rsplit("-", 1)[1]
    bucketed.write_loadspec_table(spec, f"{name}_loadspec", f"{folder}/loadspec", buckets=32)
    bucketed.write_request_table(attribution.request_rows(attempts), f"{name}_requests", f"{folder}/requests", buckets=32)
    return attribution.attribute(
        bucketed.open_request_table(spark, f"{name}_requests", f"{folder}/requests", 32),
        bucketed.open_loadspec_table(spark, f"{name}_loadspec", f"{folder}/loadspec", 32),
    )


@query("unsent_requests", JOINED + " SELECT id, url, source FROM sent WHERE code IS NULL")
def unsent_requests(spark, sf_dir):
    spec, attempts = replayed(spark, sf_dir)
    return attribution.unsent(spec, attribution.request_rows(attempts)).select("id", "url", "source")


@query(
    "latency_by_url",
    JOINED + """
    SELECT url, count(*) AS requests, CAST(count(*) FILTER (outcome IN ('client_error', 'error')) AS BIGINT) AS errors,
           round(quantile_cont(took_in_millis, 0.5) FILTER (code = 200), 6) AS p50,
           round(quantile_cont(took_in_millis, 0.9) FILTER (code = 200), 6) AS p90,
           round(quantile_cont(took_in_millis, 0.99) FILTER (code = 200), 6) AS p99,
           round(quantile_cont(took_in_millis, 0.999) FILTER (code = 200), 6) AS p999
    FROM sent WHERE code IS NOT NULL GROUP BY url""",
)
def latency_by_url(spark, sf_dir):
    spec, attempts = replayed(spark, sf_dir)
    report = attribution.latency_by(attribution.request_rows(attempts), spec)
    return report.select("url", "requests", "errors", *[F.round(q, 6).alias(q) for q in fixed.QUANTILE_NAMES])


@query(
    "cooldown_kept",
    f"""WITH RECURSIVE {SPEC}, timed AS (
      SELECT id, event_id, ts_nanos - min(ts_nanos) OVER () AS at_nanos, delay_since_last_nanos FROM spec),
    asked AS (
      SELECT t.id, at_nanos - delay_since_last_nanos AS previous_at,
             at_nanos + ((user_id % 7) * 1000 + 500) * 1000000000 AS finish
      FROM timed t JOIN events e USING (event_id) WHERE event_type = 'error' AND user_id % 5 IN (0, 1)),
    accepted AS (
      SELECT id, finish FROM asked WHERE id = (SELECT min(id) FROM asked)
      UNION ALL
      SELECT n.id, n.finish FROM accepted a, LATERAL (
        SELECT id, finish FROM asked WHERE previous_at >= a.finish ORDER BY id LIMIT 1) n)
    SELECT id, CAST(at_nanos AS BIGINT) AS at_nanos FROM timed t
    WHERE NOT EXISTS (
      SELECT 1 FROM accepted a WHERE a.id < t.id AND t.at_nanos - t.delay_since_last_nanos < a.finish)""",
)
def cooldown_kept(spark, sf_dir):
    """Pauses are taken as a thousand times as long, since events are minutes apart."""
    spec, attempts = replayed(spark, sf_dir)
    pauses = attempts.where("code IN (429, 503)").select("id", (F.col("pause_millis") * 1000 * 1_000_000).alias("pause_nanos"))
    timed = stage(sequence.schedule(spec), "schedule")
    return cooldown.kept(timed, pauses).select("id", "at_nanos")


# --- node metrics -----------------------------------------------------------

NODES = """
polls AS (
  SELECT o_orderkey AS k, o_custkey AS c, 'node-' || substr(o_orderpriority, 1, 1) AS node_id,
         epoch_us(o_orderdate) // 1000000 AS poll_ts FROM orders)"""


@query(
    "node_cpu",
    f'WITH {NODES} SELECT poll_ts, node_id, k % 100 AS percent, k * 10 AS "time" FROM polls',
)
def node_cpu(spark, sf_dir):
    return nodes.series(nodes.parse_polls(given.node_polls(spark, sf_dir)), "cpu")


@query(
    "node_series",
    f"""WITH {NODES}, tall AS (
      SELECT poll_ts, node_id, unnest([
        {{'series': 'mem.young', 'metric': 'used', 'value': k + 1}}, {{'series': 'mem.young', 'metric': 'max', 'value': k + 2}},
        {{'series': 'mem.survivor', 'metric': 'used', 'value': k + 3}}, {{'series': 'mem.survivor', 'metric': 'max', 'value': k + 4}},
        {{'series': 'mem.tenured', 'metric': 'used', 'value': k + 5}}, {{'series': 'mem.tenured', 'metric': 'max', 'value': k + 6}},
        {{'series': 'mem.heap', 'metric': 'used', 'value': c * 3}}, {{'series': 'mem.heap', 'metric': 'commited', 'value': c * 5}},
        {{'series': 'mem.nonheap', 'metric': 'used', 'value': c + 1}}, {{'series': 'mem.nonheap', 'metric': 'commited', 'value': c + 2}},
        {{'series': 'mem.os', 'metric': 'used', 'value': c}}, {{'series': 'mem.os', 'metric': 'total', 'value': c * 100}},
        {{'series': 'mem.swap', 'metric': 'used', 'value': 0}}, {{'series': 'mem.swap', 'metric': 'total', 'value': 0}},
        {{'series': 'cpu', 'metric': 'percent', 'value': k % 100}}, {{'series': 'cpu', 'metric': 'time', 'value': k * 10}},
        {{'series': 'gc.young', 'metric': 'count', 'value': k + 7}}, {{'series': 'gc.young', 'metric': 'time', 'value': k + 8}},
        {{'series': 'gc.full', 'metric': 'count', 'value': k + 9}}, {{'series': 'gc.full', 'metric': 'time', 'value': k + 10}}
      ]) AS e FROM polls)
    SELECT poll_ts, node_id, e.series AS series, e.metric AS metric, CAST(e.value AS BIGINT) AS "value" FROM tall""",
)
def node_series(spark, sf_dir):
    return nodes.all_series(nodes.parse_polls(given.node_polls(spark, sf_dir)))


@query(
    "node_gauges",
    f"""WITH {NODES}, newest AS (
      SELECT node_id, (poll_ts // 86400 + 1) * 86400 AS ts, last(k + 1 ORDER BY poll_ts, k) AS used, last(k + 2 ORDER BY poll_ts, k) AS "max"
      FROM polls GROUP BY ALL),
    spine AS (SELECT node_id, unnest(range(min(ts), max(ts) + 1, 86400)) AS ts FROM newest GROUP BY node_id)
    SELECT node_id, ts, last_value(used IGNORE NULLS) OVER w AS used, last_value("max" IGNORE NULLS) OVER w AS "max"
    FROM spine LEFT JOIN newest USING (node_id, ts)
    WINDOW w AS (PARTITION BY node_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def node_gauges(spark, sf_dir):
    """One day per tick; of the polls of a day the last order counts."""
    polls = nodes.series(nodes.parse_polls(given.node_polls(spark, sf_dir)), "mem.young")
    return reports.gauge_report(
        polls, ["used", "max"], 86_400, time="poll_ts", newest=F.struct("poll_ts", "used"), keys=["node_id"]
    )


# --- files ------------------------------------------------------------------


def in_part_order(df: DataFrame, by: str, text: str, folder: str) -> None:
    df.repartitionByRange(by).sortWithinPartitions(by).select(text).write.text(folder)


@query("slowlog_files", f"WITH {SPEC} SELECT id, delay_since_last_nanos, url, source FROM spec")
def slowlog_files(spark, sf_dir):
    """Lines written as text files, then read, parsed and written as a loadspec, then read."""
    folder = new_folder(spark, "files")
    in_part_order(given.slowlog_lines(spark, sf_dir), "ord", "value", folder + "/log")
    spec = loadspecs.from_slowlog(readers.read_slowlog(spark, folder + "/log"), order=readers.LINE_ORDER)
    writers.write_loadspec(spec, folder + "/loadspec")
    return readers.read_loadspec(spark, folder + "/loadspec")


@query("dictionary_file", f"WITH {DICTIONARY} SELECT pos, replace(term, chr(10), ' ') AS term FROM dictionary")
def dictionary_file(spark, sf_dir):
    """The dictionary, without line breaks inside terms, as a text file and back."""
    folder = new_folder(spark, "files")
    terms = given.dictionary(spark, sf_dir).withColumn("term", F.replace("term", F.lit("\n"), F.lit(" ")))
    in_part_order(terms, "pos", "term", folder + "/dictionary")
    return readers.read_dictionary(spark, folder + "/dictionary")


@query(
    "request_file",
    f"""WITH {ATTEMPTS} SELECT ts, code, CASE WHEN code = 200 THEN took ELSE 0 END AS took_in_millis,
      CASE WHEN code = 200 THEN latency ELSE 0 END AS latency_micros, id FROM judged WHERE code IS NOT NULL""",
)
def request_file(spark, sf_dir):
    folder = new_folder(spark, "files")
    writers.write_requests(attribution.request_rows(given.attempts(spark, sf_dir)), folder)
    return readers.read_requests(spark, folder)


@query("pseudonym_file", f'WITH {PAGES} SELECT field, "key", anon FROM ids')
def pseudonym_file(spark, sf_dir):
    folder = new_folder(spark, "files")
    writers.write_pseudonyms(pseudonym_map(spark, sf_dir), folder, "json")
    return readers.read_pseudonyms(spark, folder, "json")


@query("hits_file", f'WITH {MATCH} SELECT "Term", "Count" FROM hits')
def hits_file(spark, sf_dir):
    """Hit counts written as JSON lines and read back."""
    folder = new_folder(spark, "files")
    indexes.hit_counts(given.documents(spark, sf_dir), given.dictionary(spark, sf_dir), path=folder)
    return spark.read.schema("Term string, Count bigint").json(folder)


@query("node_stats_files", f'WITH {NODES} SELECT poll_ts, node_id, k % 100 AS percent, k * 10 AS "time" FROM polls')
def node_stats_files(spark, sf_dir):
    """Polls stored one per line, read back and parsed."""
    folder = new_folder(spark, "files")
    given.node_polls(spark, sf_dir).select("body").write.text(folder)
    return nodes.series(readers.read_node_stats(spark, folder, one_per_line=True), "cpu")


def fixed_text(column: str) -> str:
    """A double with two decimals, a half of what it prints as away from zero, as text; NaN for none."""
    return f"coalesce(CAST(CAST(round(CAST(CAST({column} AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DECIMAL(30, 2)) AS VARCHAR), 'NaN')"


def between_sql(values: str, q: float) -> str:
    """The quantile of a sorted list, between two values by weights: written files show each double's last digit."""
    at = f"((len({values}) - 1) * {q}::DOUBLE)"
    low, high = f"{values}[CAST(floor({at}) AS BIGINT) + 1]", f"{values}[CAST(ceil({at}) AS BIGINT) + 1]"
    return f"CASE WHEN {low} = {high} THEN CAST({low} AS DOUBLE) ELSE (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high} END"


def report_lines_sql() -> str:
    """Every line of the 14 report files of a test, a day per tick."""
    days = "days AS (SELECT unnest(range(min(day), max(day) + 1, 86400)) AS ts FROM per_day)"
    per_day = f"""per_day AS (
      SELECT (ts // 86400 + 1) * 86400 AS day, count(*) AS sent,
             count(*) FILTER (outcome IN ('transport', 'client_error', 'error')) AS failed,
             count(*) FILTER (code = 200) AS took_n, list_sort(list(took) FILTER (code = 200)) AS took_v,
             count(*) FILTER (outcome = 'throttled') AS pause_n, list_sort(list(pause) FILTER (outcome = 'throttled')) AS pause_v
      FROM judged GROUP BY day)"""
    files = []
    for name, value in ((fixed.RESPONSE_TIME, "took"), (fixed.PAUSE_TIME, "pause")):
        texts = " || ',' || ".join(fixed_text(between_sql(f"{value}_v", q)) for q in fixed.QUANTILES)
        files.append(f"SELECT '{name}' AS file, ts || ',' || coalesce({value}_n, 0) || ',' || {texts} AS line FROM days LEFT JOIN per_day ON day = ts")
    for name, value in ((fixed.REQUESTS_SENT, "sent"), (fixed.ERRORS, "failed")):
        files.append(
            f"SELECT '{name}', ts || ',' || CAST(sum(coalesce({value}, 0)) OVER (ORDER BY ts) AS BIGINT) FROM days LEFT JOIN per_day ON day = ts"
        )
    files.append(
        f"""SELECT '{fixed.REQUEST}', ts || ',' || code || ',' || CASE WHEN code = 200 THEN took || ',' || latency ELSE '0,0' END || ',' || id
        FROM judged WHERE code IS NOT NULL"""
    )
    values = {
        "mem.young": ("k + 1", "k + 2"), "mem.survivor": ("k + 3", "k + 4"), "mem.tenured": ("k + 5", "k + 6"), "mem.heap": ("c * 3", "c * 5"),
        "mem.nonheap": ("c + 1", "c + 2"), "mem.os": ("c", "c * 100"), "mem.swap": ("0", "0"), "cpu": ("k % 100", "k * 10"),
        "gc.young": ("k + 7", "k + 8"), "gc.full": ("k + 9", "k + 10"),
    }
    # Of polls of one time the one with the greatest values, the first series first, counts.
    for name, (first, second) in values.items():
        files.append(f"SELECT '{name}', node_id || ',' || ts || ',' || ({first}) || ',' || ({second}) FROM held")
    newest = """newest AS (
      SELECT node_id, (poll_ts // 86400 + 1) * 86400 AS ts, last(k ORDER BY poll_ts, k) AS k, last(c ORDER BY poll_ts, k) AS c FROM polls GROUP BY ALL),
    nodes AS (SELECT node_id, unnest(range(min(ts), max(ts) + 1, 86400)) AS ts FROM newest GROUP BY node_id),
    held AS (
      SELECT node_id, ts, last_value(k IGNORE NULLS) OVER w AS k, last_value(c IGNORE NULLS) OVER w AS c FROM nodes LEFT JOIN newest USING (node_id, ts)
      WINDOW w AS (PARTITION BY node_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
    return f"WITH {ATTEMPTS}, {per_day}, {days}, {NODES}, {newest} " + " UNION ALL ".join(files)


@query("report_files", report_lines_sql())
def report_files(spark, sf_dir):
    """All 14 report files of a test, a day per tick, read back line by line."""
    folder = new_folder(spark, "files")
    polls = stage(nodes.parse_polls(given.node_polls(spark, sf_dir)), "polls")
    reports_job.write_reports(stage(given.attempts(spark, sf_dir), "attempts"), folder, node_stats=polls, interval=86_400)
    names = [fixed.RESPONSE_TIME, fixed.PAUSE_TIME, fixed.REQUESTS_SENT, fixed.ERRORS, fixed.REQUEST, *fixed.NODE_SERIES]
    paths = [writers.metric_path(folder, name, "1") for name in names]
    # Each with a header; CSV of one column is the line.
    lines = spark.read.option("sep", "\x01").schema("line string").csv(paths, header=True, enforceSchema=True)
    return lines.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)_1\.csv/[^/]*$", 1).alias("file"), "line")


@query(
    "index_copy",
    f"""WITH {PAGES}
    SELECT page_id AS _id, coalesce(replace(url, host, h.anon), url) AS url,
           coalesce(replace(lang, lang, l.anon), lang) AS lang,
           (SELECT md5(p.html) FROM pages AS p WHERE p.page_id = found.page_id) AS html {SWAPPED}""",
)
def index_copy(spark, sf_dir):
    """An index dumped as JSON lines, copied with pseudonyms and read back.

    The split size changes between the two, which must not matter."""
    folder = new_folder(spark, "files")
    writers.write_documents(given.page_documents(spark, sf_dir).orderBy("_id"), folder + "/dump")
    dumped = readers.read_documents(spark, folder + "/dump")
    # Keys are numbered in the order of pages.
    named = dumped.withColumn("_page", F.get_json_object("body", "$._id").cast("bigint"))
    options = [*PAGE_OPTIONS]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    indexes.pseudonymise_index(named, options, ["_page"], folder + "/copy", folder + "/map", body="body", dictionary_format="json")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        copied = stage(spark.read.text(folder + "/copy"), "copy")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    member = lambda path: F.get_json_object("value", path)
    return copied.select(
        member("$._id").cast("bigint").alias("_id"), member("$.url").alias("url"), member("$._source.lang").alias("lang"),
        F.md5(member("$._source.html")).alias("html"),
    )


@query(
    "document_slice",
    "SELECT page_id AS _id, url FROM pages ORDER BY page_id LIMIT 120 OFFSET 30",
)
def document_slice(spark, sf_dir):
    pages = given.page_documents(spark, sf_dir).select("_id", "url")
    return readers.slice_documents(pages, ["_id"], offset=30, total=120)


@query(
    "pseudonymised_json",
    f"""WITH {PAGES}
    SELECT page_id AS _id, coalesce(replace(url, host, h.anon), url) AS url,
           coalesce(replace(lang, lang, l.anon), lang) AS lang,
           coalesce(replace(url || '#top', host, h.anon), url || '#top') AS link {SWAPPED}""",
)
def pseudonymised_json(spark, sf_dir):
    """Pages as JSON text of unknown shape."""
    pages = given.page_documents(spark, sf_dir)
    text = pages.select("_id", F.to_json(F.struct(*pages.columns)).alias("body"))
    rewritten, _ = pseudonyms.json_pseudonymise(text, page_patterns(), ["_id"])
    member = lambda path: F.get_json_object("body", path)
    return rewritten.select(
        "_id", member("$.url").alias("url"), member("$._source.lang").alias("lang"), member("$.links[0].url").alias("link")
    )


@query(
    "pseudonymised_variant",
    f"""WITH {PAGES},
    known AS (SELECT page_id AS _id, url, html, CASE page_id % 10 WHEN 3 THEN NULL ELSE lang END AS lang FROM found JOIN pages USING (page_id, url)),
    swapped AS (
      SELECT _id, coalesce(replace(known.url, h."key", h.anon), known.url) AS url, coalesce(l.anon, lang) AS lang, html,
             coalesce(replace(known.url || '#top', h."key", h.anon), known.url || '#top') AS link
      FROM known LEFT JOIN ids h ON h.field = 'url' AND h."key" = regexp_extract(known.url, 'https?://([^/]+)', 1)
      LEFT JOIN lang_ids l ON l."key" = lang)
    SELECT _id, url, lang, link, md5(html) AS html, length(html) AS size,
           CASE _id % 10 WHEN 3 THEN 'null' WHEN 4 THEN 'number' ELSE 'typed' END AS kind FROM swapped""".replace(
        "swapped AS", """lang_firsts AS (SELECT lang AS "key", min(_id) AS first FROM known WHERE lang <> '' GROUP BY lang),
    lang_ids AS (SELECT "key", CAST(row_number() OVER (ORDER BY first) - 1 AS VARCHAR) AS anon FROM lang_firsts),
    swapped AS""", 1),
)
def pseudonymised_variant(spark, sf_dir):
    """Pages as JSON text, most of one shape; some have a null member, some a member of another kind."""
    pages = given.page_documents(spark, sf_dir)
    text = pages.select("_id", F.to_json(F.struct(*pages.columns)).alias("body"))
    kind = F.pmod("_id", F.lit(10))
    changed = (
        F.when(kind == 3, F.regexp_replace("body", r'"lang":"[^"]*"', '"lang":null'))
        .when(kind == 4, F.regexp_replace("body", r'"size":(\d+)', r'"size":"$1"'))
        .otherwise(F.col("body"))
    )
    rewritten, _ = shaped.pseudonymise_shaped(text.withColumn("body", changed), page_patterns(), ["_id"])
    rows = stage(rewritten, "rewritten")
    member = lambda path: F.get_json_object("body", path)
    size = F.get_json_object("body", "$._source.size").cast("bigint")
    shown = F.when(F.contains("body", F.lit('"lang":null')), "null").when(F.col("body").rlike('"size":"'), "number").otherwise("typed")
    return rows.select(
        "_id", member("$.url").alias("url"), member("$._source.lang").alias("lang"), member("$.links[0].url").alias("link"),
        F.md5(member("$._source.html")).alias("html"), size.alias("size"), shown.alias("kind"),
    )


@query(
    "response_fields",
    """SELECT event_id AS id,
      CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS took,
      CASE WHEN event_type <> 'error' THEN user_id END AS total,
      CASE WHEN event_type = 'error' THEN 'type-' || (user_id % 4) END AS error_type,
      CASE WHEN event_type = 'error' THEN 'reason ' || user_id END AS error_reason,
      CASE WHEN event_type = 'error' THEN (user_id % 7) * 1000 + 250 END AS pause_millis,
      CAST(floor(value * 1000000) AS BIGINT) // 1000 AS latency_micros
    FROM events""",
)
def response_fields(spark, sf_dir):
    body = F.col("body")
    return given.responses(spark, sf_dir).select(
        "id",
        outcomes.took_millis(body).alias("took"),
        outcomes.hits_total(body).alias("total"),
        outcomes.error_type(body).alias("error_type"),
        outcomes.error_reason(body).alias("error_reason"),
        outcomes.retry_after_millis(F.col("retry_after")).alias("pause_millis"),
        outcomes.latency_micros(F.col("latency_nanos")).alias("latency_micros"),
    )


@query("hit_requests", f"WITH {DICTIONARY} SELECT count(*) AS requests FROM dictionary")
def hit_requests(spark, sf_dir):
    return hits.requests_made(given.dictionary(spark, sf_dir))


@query("match_all_hits", f'WITH {DICTIONARY} SELECT pos, term AS "Term", (SELECT count(*) FROM documents) AS "Count" FROM dictionary')
def match_all_hits(spark, sf_dir):
    return hits.count_hits(given.documents(spark, sf_dir), given.dictionary(spark, sf_dir), "match_all")


@query(
    "single_gauge_report",
    f"""WITH {ATTEMPTS}, newest AS (SELECT tick, last(latency ORDER BY ts, id) AS v FROM judged GROUP BY tick)
    SELECT s.ts, coalesce(last_value(v IGNORE NULLS) OVER w, 0) AS "value"
    FROM spine s LEFT JOIN newest ON tick = s.ts
    WINDOW w AS (ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def single_gauge_report(spark, sf_dir):
    polls = given.attempts(spark, sf_dir).select("ts", "id", F.col("latency_micros").alias("value"))
    return reports.gauge_report(polls, ["value"], TICK, newest=F.struct("ts", "id"))


# --- streams ----------------------------------------------------------------


def written(spark, arriving: DataFrame, by: str, transform) -> DataFrame:
    """Run an append-mode stream over all arrivals and read its output."""
    folder = new_folder(spark, "stream")
    schemas = []

    def start(stream):
        out = transform(stream)
        schemas.append(out.schema)
        writer = out.writeStream.format("parquet").option("checkpointLocation", folder + "-checkpoint")
        return writer.option("path", folder).outputMode("append").trigger(availableNow=True).start()

    given.replay(arriving, by, start)
    return spark.read.schema(schemas[-1]).parquet(folder)


def timed_events(spark, sf_dir) -> DataFrame:
    return given.table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("time"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("us"),
        F.expr("cast(floor(value) as bigint)").alias("took_in_millis"),
    )


def updated(spark, arriving: DataFrame, by: str, transform) -> DataFrame:
    """Run an aggregation over all arrivals and read each tick's newest row."""
    folder = new_folder(spark, "stream")
    schemas = []

    def start(stream):
        out = transform(stream)
        schemas.append(out.schema)
        return batches.write_updates(out, folder, folder + "-checkpoint")

    given.replay(arriving, by, start)
    return batches.newest(spark, folder, ["ts"], schemas[-1])


HOURS = """
hours AS (SELECT *, epoch_us(ts) // 3600000000 * 3600 + 3600 AS tick FROM events),
spine AS (SELECT unnest(range(min(tick), max(tick) + 1, 3600)) AS ts FROM hours)"""


@query(
    "stream_latency",
    f"""WITH {HOURS}, q AS (
      SELECT tick, count(*) AS n, quantile_cont(CAST(floor(value) AS BIGINT), [0.5, 0.9, 0.99, 0.999]) AS v
      FROM hours GROUP BY tick)
    SELECT ts, coalesce(n, 0) AS "count", round(v[1], 6) AS p50, round(v[2], 6) AS p90, round(v[3], 6) AS p99,
           round(v[4], 6) AS p999 FROM spine LEFT JOIN q ON tick = ts""",
)
def stream_latency(spark, sf_dir):
    """Every tick, the last one too."""
    ticked = updated(
        spark,
        timed_events(spark, sf_dir),
        "us",
        lambda rows: ticks.histogram_ticks(rows, "took_in_millis", 3600, watermark="10 minutes"),
    )
    return rounded(ticks.histogram_so_far(ticked, 3600))


@query(
    "stream_rollup",
    rollup_sql(
        HOURS,
        """SELECT 'hour' AS level, tick AS ts, CAST(floor(value) AS BIGINT) AS v FROM hours
           UNION ALL SELECT 'day', (epoch_us(ts) // 86400000000 + 1) * 86400, CAST(floor(value) AS BIGINT) FROM hours""",
    ),
)
def stream_rollup(spark, sf_dir):
    """Hours sketched on a stream, merged to days."""
    rows = timed_events(spark, sf_dir)
    hours = updated(spark, rows, "us", lambda rows: ticks.sketch_ticks(rows, "took_in_millis", 3600, watermark="10 minutes"))
    stored = stage(hours, "stored-hours")
    seen = rows.withColumn("ts", F.expr("us div 1000000"))
    return rolled_up({"hour": (stored, 3600), "day": (sketches.merged(stored, 86_400), 86_400)}, seen, F.col("took_in_millis"))


ARRIVALS = """
seconds AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS ts, event_id % 20 = 0 AS delayed FROM events),
arriving AS (
  SELECT *, least(CAST(floor((ts - min(ts) OVER ()) * 3 / (max(ts) OVER () - min(ts) OVER () + 1)) AS BIGINT) + CAST(delayed AS BIGINT), 2) AS arrival,
         (ts // 3600 + 1) * 3600 AS tick
  FROM seconds),
latest AS (SELECT arrival, max(ts) AS latest FROM arriving GROUP BY arrival),
judged AS (
  SELECT *, coalesce(tick <= (SELECT max(latest) FROM latest WHERE latest.arrival < arriving.arrival) - 600, FALSE) AS late FROM arriving)"""


def arrived(spark, sf_dir) -> tuple[str, dict]:
    """Events that arrive in three batches, one of twenty with the next one."""
    folder = new_folder(spark, "arrivals")
    measures = {**late.histogram(F.col("took_in_millis")), **late.counter("errors", F.col("event_type") == "error")}
    given.replay(
        timed_events(spark, sf_dir).withColumn("ts", F.expr("us div 1000000")).drop("time"),
        "ts",
        lambda rows: late.stream_ticks(rows, measures, folder, folder + "-checkpoint", 3600, allowed_seconds=600),
        delayed=F.col("event_id") % 20 == 0,
    )
    return folder, measures


@query("stream_late", f"WITH {ARRIVALS} SELECT event_id, event_type, ts FROM judged WHERE late")
def stream_late(spark, sf_dir):
    """What came after its tick was closed."""
    folder, _ = arrived(spark, sf_dir)
    return late.late_rows(spark, folder).select("event_id", "event_type", "ts")


@query(
    "stream_timely",
    f"""WITH {ARRIVALS}
    SELECT tick AS ts, count(*) AS "count", count(*) FILTER (event_type = 'error') AS errors,
           (SELECT count(*) FROM judged WHERE late) AS late, (SELECT count(*) FROM judged) AS arrived
    FROM judged WHERE NOT late GROUP BY tick""",
)
def stream_timely(spark, sf_dir):
    """Ticks of what came in time, and how much did not."""
    folder, measures = arrived(spark, sf_dir)
    so_far = late.arrivals_so_far(spark, folder).first()
    counted = late.ticks_so_far(spark, folder, measures)
    return counted.select("ts", "count", "errors", *[F.lit(so_far[c]).cast("bigint").alias(c) for c in ("late", "arrived")])


@query(
    "stream_errors",
    f"""WITH {HOURS}, per_tick AS (
      SELECT tick, count(*) FILTER (event_type = 'error') AS n FROM hours GROUP BY tick)
    SELECT ts, CAST(sum(coalesce(n, 0)) OVER (ORDER BY ts) AS BIGINT) AS "value" FROM spine LEFT JOIN per_tick ON tick = ts""",
)
def stream_errors(spark, sf_dir):
    counts = updated(
        spark,
        timed_events(spark, sf_dir),
        "us",
        lambda rows: ticks.counter_ticks(rows, F.col("event_type") == "error", 3600, watermark="10 minutes"),
    )
    return ticks.counter_so_far(counts, 3600)


@query(
    "stream_gauges",
    f"""WITH {HOURS}, newest AS (
      SELECT tick, last(CAST(floor(value) AS BIGINT) ORDER BY epoch_us(ts), event_id) AS v FROM hours GROUP BY tick)
    SELECT s.ts, coalesce(last_value(v IGNORE NULLS) OVER w, 0) AS took_in_millis
    FROM spine s LEFT JOIN newest ON tick = s.ts
    WINDOW w AS (ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def stream_gauges(spark, sf_dir):
    polled = updated(
        spark,
        timed_events(spark, sf_dir),
        "us",
        lambda rows: ticks.gauge_ticks(rows, ["took_in_millis"], F.struct("us", "event_id"), 3600, watermark="10 minutes"),
    )
    return ticks.gauges_so_far(polled, ["took_in_millis"], 3600)


@query(
    "stream_delays",
    """SELECT event_id, event_type, epoch_us(ts) AS us,
              coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0) AS delay,
              FALSE AS late
    FROM events""",
)
def stream_delays(spark, sf_dir):
    folder = new_folder(spark, "delays")
    given.replay(
        timed_events(spark, sf_dir).select("event_id", "event_type", "us"),
        "us",
        lambda rows: delays.stream_delays(
            rows, "event_type", "us", ["event_id"], folder + "/out", folder + "/state", folder + "/checkpoint"
        ),
    )
    return batches.read_all(spark, folder + "/out")


@query(
    "stream_delays_unordered",
    """WITH delays AS (
      SELECT event_id, event_type, epoch_us(ts) AS us,
             coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0) AS delay
      FROM events)
    SELECT * FROM delays WHERE us < (SELECT (max(us) // 1000 - (max(us) - min(us)) // 2000) * 1000 FROM delays)""",
)
def stream_delays_unordered(spark, sf_dir):
    """Events in no order, one of seven comes an arrival late; out is what the watermark, half the test behind, has passed."""
    folder = new_folder(spark, "delays")
    events = timed_events(spark, sf_dir).select("event_id", "event_type", "us")
    millis = events.selectExpr("(max(us) - min(us)) div 2000").first()[0]
    given.replay(
        events.repartition(4, F.xxhash64("event_id")),
        "us",
        lambda rows: ordered.stream_delays_unordered(
            rows, "event_type", "us", ["event_id"], folder + "/out", folder + "/checkpoint", watermark=f"{millis} milliseconds"
        ),
        delayed=F.col("event_id") % 7 == 0,
    )
    return spark.read.schema("event_id bigint, event_type string, us bigint, delay bigint").parquet(folder + "/out")


@query("stream_loadspec", f"WITH {SPEC} SELECT id, delay_since_last_nanos, url, source FROM spec")
def stream_loadspec(spark, sf_dir):
    """The loadspec of a slow log that arrives in parts."""
    folder = new_folder(spark, "loadspec")
    lines = given.slowlog_lines(spark, sf_dir)
    time = F.coalesce(
        F.try_to_timestamp(F.substring("value", 2, 23), F.lit("yyyy-MM-dd HH:mm:ss,SSS")),
        F.try_to_timestamp(F.substring("value", 2, 10), F.lit("yyyy-MM-dd")),
    )
    given.replay(
        lines.withColumn("millis", F.unix_millis(time)),
        "millis",
        lambda arriving: loadspec_stream.stream_loadspec(arriving, folder, folder + "-checkpoint", ["ord"]),
    )
    return loadspec_stream.read_loadspec(spark, folder)


def sent_and_answered(spark, sf_dir, part) -> DataFrame:
    """Loadspec entries and responses as two streams; a last pair, far behind all others, closes the test."""
    spec, attempts = replayed(spark, sf_dir)
    came_back = attribution.request_rows(attempts)
    times = attempts.select("id", F.timestamp_seconds("ts").alias("sent_time"))
    entries = spec.select("id", "url", "source").join(times, "id")
    answers = came_back.select("id", "code", F.timestamp_seconds(F.col("ts") + 1).alias("time"))
    kinds = entries.select("id", "url", "source", "sent_time", F.lit(None).cast("int").alias("code"), F.lit(None).cast("timestamp").alias("time"))
    kinds = kinds.unionByName(answers, allowMissingColumns=True)
    moment = F.coalesce("sent_time", "time")
    far = kinds.agg((F.max(moment) + F.expr("INTERVAL 30 DAYS")).alias("far")).select(
        F.explode(F.expr("array(-1L, -2L)")).alias("id"), "far"
    )
    closing = far.select("id", F.when(F.col("id") == -1, F.col("far")).alias("sent_time"), F.when(F.col("id") == -2, F.col("far")).alias("time"))
    rows = stage(kinds.unionByName(closing, allowMissingColumns=True).withColumn("at", F.unix_seconds(moment)), "two-streams")
    # The closing pair arrives with the rest of the test, not a month later.
    last = rows.where("id >= 0").agg(F.max("at")).first()[0]
    rows = rows.withColumn("at", F.least("at", F.lit(last)))

    def joined(stream):
        sent = stream.where("sent_time is not null").select("id", "url", "source", "sent_time")
        responses = stream.where("time is not null").select("id", "code", "time")
        return part(attribution_stream.attributed(sent, responses, 60, watermark="10 minutes"))

    return written(spark, rows, "at", joined).where("id >= 0")


@query("stream_unsent", JOINED + " SELECT id, url, source FROM sent WHERE code IS NULL")
def stream_unsent(spark, sf_dir):
    """Entries that leave without a response once the watermark has passed the time for one."""
    return sent_and_answered(spark, sf_dir, attribution_stream.unsent).select("id", "url", "source")


@query("stream_attribution", JOINED + " SELECT id, url, source, code FROM sent WHERE code IS NOT NULL")
def stream_attribution(spark, sf_dir):
    """Responses joined with their entries as they come."""
    return sent_and_answered(spark, sf_dir, attribution_stream.answered).select("id", "url", "source", "code")


@query(
    "stream_slowlog",
    f"""WITH {LOG} SELECT ts_nanos, body, host || '/' || event_type || '/' || types || '/_search?search_type=' || search_type AS url
    FROM log""",
)
def stream_slowlog(spark, sf_dir):
    return written(
        spark,
        given.slowlog_lines(spark, sf_dir),
        "ord",
        lambda lines: slowlog_stream.parsed_requests(lines).select("ts_nanos", "body", "url"),
    )


@query(
    "stream_pseudonyms",
    f"""WITH {PAGES}
    SELECT page_id AS _id, coalesce(replace(url, host, h.anon), url) AS url,
           coalesce(replace(url, host, h.anon), url) AS source_url,
           coalesce(replace(lang, lang, l.anon), lang) AS source_lang, size AS source_size {SWAPPED}""",
)
def stream_pseudonyms(spark, sf_dir):
    folder = new_folder(spark, "pseudonyms")
    given.replay(
        given.page_documents(spark, sf_dir).drop("links"),
        "_id",
        lambda pages: stream_pseudonymise(
            pages, page_patterns(), ["_id"], folder + "/out", folder + "/map", folder + "/checkpoint"
        ),
    )
    return page_columns(batches.read_all(spark, folder + "/out"))


@query(
    "stream_json_pseudonyms",
    f"""WITH {PAGES}
    SELECT page_id AS _id, coalesce(replace(url, host, h.anon), url) AS url,
           coalesce(replace(lang, lang, l.anon), lang) AS lang {SWAPPED}""",
)
def stream_json_pseudonyms(spark, sf_dir):
    """Search hits as JSON text that keep arriving."""
    folder = new_folder(spark, "pseudonyms")
    pages = given.page_documents(spark, sf_dir)
    given.replay(
        pages.select("_id", F.to_json(F.struct(*pages.columns)).alias("body")),
        "_id",
        lambda hits_: stream_pseudonymise(
            hits_, page_patterns(), ["_id"], folder + "/out", folder + "/map", folder + "/checkpoint", body="body"
        ),
    )
    member = lambda path: F.get_json_object("body", path)
    return batches.read_all(spark, folder + "/out").select("_id", member("$.url").alias("url"), member("$._source.lang").alias("lang"))
