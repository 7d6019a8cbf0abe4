"""The operators applied to the given tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlab.llm import centroids, codes, compact, containment, embeddings, lm, mixing, neardup, packing, pii, suffixes, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS t(p)),
si AS (SELECT DISTINCT item_id, array_to_string(w[p:p+4], ' ') AS s FROM i, unnest(range(1, len(w) - 3)) AS t(p)),
n AS (SELECT item_id, count(*) AS n FROM si GROUP BY 1)
SELECT doc_id, item_id, n AS item_shingles, count(*) AS shared, CAST(count(*) AS DOUBLE) / n AS containment
FROM ds JOIN si USING (s) JOIN n USING (item_id) GROUP BY 1, 2, 3 HAVING 5 * count(*) >= 4 * n
"""


@query("op1_decontaminate", OP1)
def op1_decontaminate(spark, sf_dir):
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_score_by_models")
def op2_score_by_models(spark, sf_dir):
    """How much more each document reads like a conversation than like the corpus."""
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))


@query("op3_near_duplicates")
def op3_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, width=2)


@query("op4_personal_data")
def op4_personal_data(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    base = F.sha2(joined(of(*pii.BASE)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


OP7 = """
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) >= 0.93 * a.norm * b.norm),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links AS l ON r.b = l.a)
  SELECT a, min(b) AS least FROM r GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
found AS (
  SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id
  FROM embeddings LEFT JOIN degree ON degree.a = vec_id LEFT JOIN reach ON reach.a = vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""


@query("op7_near_embeddings", OP7)
def op7_near_embeddings(spark, sf_dir):
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op8_near_passages")
def op8_near_passages(spark, sf_dir):
    return compact.near_duplicate_passages(table(spark, sf_dir, "documents"))


OP9 = r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
filling AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum(source_size) OVER f - source_size AS before,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM per WINDOW f AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
filled AS (SELECT *, 4 * source_size * open <= w * (3 * total - 4 * before) AS is_full FROM filling),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(w * (3 * total - 4 * sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(2 * sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM filled),
queued AS (
  SELECT r, doc_id, source, shuffle, size, CAST(sum(size) OVER q - size AS BIGINT) AS start
  FROM sized WINDOW q AS (PARTITION BY source ORDER BY shuffle, size ROWS UNBOUNDED PRECEDING)),
offered AS (
  SELECT r, doc_id, source, shuffle, size, source_size, target, repeat,
         start + repeat * source_size AS began,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - repeat * source_size)) AS words
  FROM queued JOIN targets USING (source) , (VALUES (0), (1)) AS e(repeat)
  WHERE source IS NOT NULL
  UNION ALL
  SELECT r, doc_id, source, shuffle, size, t.source_size, t.target, repeat,
         start + repeat * t.source_size,
         greatest(0, least(size, CAST(floor(t.target) AS BIGINT) - start - repeat * t.source_size))
  FROM queued, (SELECT source_size, target FROM targets WHERE source IS NULL) AS t, (VALUES (0), (1)) AS e(repeat)
  WHERE source IS NULL),
placed AS (
  SELECT *, CASE WHEN words > 0 THEN CAST(sum(words) OVER m - words AS BIGINT) END AS place
  FROM offered
  WINDOW m AS (ORDER BY CASE WHEN words > 0 THEN CAST(began + words AS DOUBLE) / target END NULLS LAST,
                        source NULLS LAST, repeat, shuffle, size ROWS UNBOUNDED PRECEDING))
SELECT first(doc_id) AS doc_id, CAST(first(size) AS BIGINT) AS size, first(source_size) AS source_size,
       first(target) AS target, CAST(sum(words) AS BIGINT) AS taken, min(place) AS position
FROM placed GROUP BY r
"""


@query("op9_mix_sources", OP9)
def op9_mix_sources(spark, sf_dir):
    return mixing.shares(table(spark, sf_dir, "documents"))


@query("op5_repeated_passages")
def op5_repeated_passages(spark, sf_dir):
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query("op6_pack_tokens")
def op6_pack_tokens(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.train(documents.where(~held_out()), labels.where(~held_out()))
    scored = toxicity.score(documents, model)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


def means_sql(assigned: str, book: str) -> str:
    """Codebook ``book`` (p, e, v) with each entry that owns vectors of ``assigned`` (p, e, v) moved to their mean, rounded down."""
    return f"""
  SELECT p, e, coalesce(moved, v) AS v FROM {book} LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / n) AS DOUBLE) ORDER BY pos) AS moved FROM (
      SELECT p, e, pos, sum(v[pos]) AS s, count(*) AS n FROM {assigned}, unnest(range(1, len(v) + 1)) AS t(pos) GROUP BY p, e, pos)
    GROUP BY p, e) USING (p, e)"""


def nearest_sql(vectors: str, book: str) -> str:
    """``r, p, v`` of ``vectors`` with the nearest entry ``e`` of ``book`` and its squared distance ``d``."""
    return f"""
  SELECT r, p, v, m % 256 AS e, m // 256 AS d FROM (
    SELECT r, p, any_value(a.v) AS v, min(256 * CAST(
      list_dot_product(a.v, a.v) - 2 * list_dot_product(a.v, b.v) + list_dot_product(b.v, b.v) AS BIGINT) + e) AS m
    FROM {vectors} AS a JOIN {book} AS b USING (p) GROUP BY r, p)"""


def rounds_sql(vectors: str, rounds: int) -> str:
    """Books ``b0`` (given) to ``b<rounds>`` and assignments ``a0`` to ``a<rounds>``."""
    steps = [f"a0 AS MATERIALIZED ({nearest_sql(vectors, 'b0')})"]
    for i in range(1, rounds + 1):
        steps.append(f"b{i} AS MATERIALIZED ({means_sql(f'a{i - 1}', f'b{i - 1}')})")
        steps.append(f"a{i} AS MATERIALIZED ({nearest_sql(vectors, f'b{i}')})")
    return ",\n".join(steps)


SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE {SOUND}),
vectors AS MATERIALIZED (
  SELECT r, p, x[p * (len(x) // 4) + 1:(p + 1) * (len(x) // 4)] AS v FROM kept, unnest(range(4)) AS t(p)),
b0 AS MATERIALIZED (
  SELECT p, e, v FROM vectors JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 256) USING (r)),
{rounds_sql("vectors", 4)},
digest AS (
  SELECT sha256(string_agg(CAST(CAST(v[pos] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, pos)) AS codebooks_sha256
  FROM b4, unnest(range(1, len(v) + 1)) AS t(pos)),
coded AS (
  SELECT vec_id, label, code, error FROM kept JOIN (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r) USING (r))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest
"""


@query("op11_vector_codes", OP11)
def op11_vector_codes(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


OP12 = """
WITH h AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS s,
         first_value(page_id) OVER w AS first, row_number() OVER w AS n
  FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id)),
d AS (SELECT DISTINCT s, list_aggregate(list_transform(range(8), lambda i: to_base(CAST('0x' || substr(s, 5 * i + 1, 5) AS BIGINT), 32, 4)), 'string_agg', '') AS b FROM h)
SELECT page_id, payload_bytes, translate(b, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to
FROM h JOIN d USING (s)
"""


@query("op12_archive_pages", OP12)
def op12_archive_pages(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


OP13 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, 0 AS p, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE {SOUND} AND len(embedding) = 64),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS e, v FROM kept QUALIFY e < 16),
{rounds_sql("kept", 3)},
digest AS (
  SELECT e, sha256(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM b3)
SELECT vec_id, CAST(e AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY e) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN (SELECT r, vec_id FROM kept) USING (r) JOIN digest USING (e)
"""


@query("op13_centroid_clusters", OP13)
def op13_centroid_clusters(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))
