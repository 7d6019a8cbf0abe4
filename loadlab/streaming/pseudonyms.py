"""Pseudonyms for documents that keep arriving.

The stream's checkpoint is the position to resume from, the dictionary parts of
earlier batches are the known map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loadlab import schemas
from loadlab.operators import pseudonyms
from loadlab.session import fits_broadcast, stage
from loadlab.streaming.batches import fold, read_before, read_parts, write_batch

USED = "field string, used bigint"


def stream_pseudonymise(
    stream: DataFrame,
    patterns: dict[str, str],
    order: list[str],
    out: str,
    dictionary: str,
    checkpoint: str,
    known: DataFrame | None = None,
    body: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Write rewritten documents to ``out`` and new keys to ``dictionary``, per batch.

    With ``body`` the documents are JSON text in that column, else they are typed.  A batch reads the
    dictionary once, for the keys that it holds; how many ids a field has used is handed on
    as a row per field.  :func:`read_dictionary` reads the dictionary.
    """

    def process(documents: DataFrame, batch_id: int) -> None:
        spark = documents.sparkSession
        arrived = stage(documents, "arrived")
        if body is None:
            found = stage(pseudonyms.occurrences(arrived, order, patterns), "occurrences")
        else:
            found = stage(pseudonyms.json_occurrences(arrived, order, patterns, body), "occurrences")
        before = read_before(spark, dictionary, batch_id, schemas.PSEUDONYMS)
        if known is not None:
            before = before.unionByName(known.select("field", "key", "anon"))
        occur = stage(found.select("field", "key").distinct(), "occurring")
        sent = F.broadcast(occur) if fits_broadcast(occur, ["field", "key"]) else occur
        here = stage(before.join(sent, ["field", "key"], "left_semi"), "known-here")
        if batch_id:
            used = spark.read.schema(USED).parquet(f"{dictionary}/used/batch={batch_id - 1}")
        else:
            used = pseudonyms.ids_used(pseudonyms.empty_map(spark) if known is None else known)
        write_batch(pseudonyms.fresh_keys(found, order, here, used), dictionary, batch_id)
        fresh = spark.read.schema(schemas.PSEUDONYMS).parquet(f"{dictionary}/batch={batch_id}")
        added = fresh.groupBy("field").agg(F.count("*").alias("added"))
        total = F.coalesce("used", F.lit(0)) + F.coalesce("added", F.lit(0))
        write_batch(used.join(added, "field", "full").select("field", total.alias("used")), f"{dictionary}/used", batch_id)
        needed = here.unionByName(fresh)
        if body is None:
            rewritten = pseudonyms.rewrite(arrived, patterns, needed, order, found)
        else:
            rewritten = pseudonyms.json_rewrite(arrived, patterns, needed, order, body, found)
        write_batch(rewritten, out, batch_id)
        fold(spark, dictionary, batch_id, schemas.PSEUDONYMS)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_dictionary(spark: SparkSession, dictionary: str) -> DataFrame:
    """``field, key, anon`` of all batches so far."""
    return read_parts(spark, dictionary, schemas.PSEUDONYMS).drop("batch")
