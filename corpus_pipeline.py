"""From raw documents to packed training rows, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that the
one before it kept; every result is written as Parquet and read again.  All but
the last return the columns of ``docs``.  NULL and empty texts and NULL keys pass
every filter (they are no duplicates, not toxic, contain nothing); the mix takes no document without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loadlab.llm import containment, mixing, neardup, packing, toxicity
from loadlab.llm.queries import held_out
from loadlab.session import stage

#: Tokenization has no SQL form; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5.  The classifier learns from the labels that are not held out."""
    labels = _table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(~held_out()), labels.where(~held_out()))
    others = [c for c in docs.columns if c != "doc_id"]
    return toxicity.score(docs, model, keep=others).where("score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; repeated rows once."""
    found = stage(neardup.near_duplicates(docs), "near-duplicates")
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    stays = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stays.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return containment.without(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, cut to the words it takes."""
    takes = mixing.mix(docs).select("row", "doc_id", "source", "size", "words")
    same = ["doc_id", "source", "size"]
    # Rows that agree in these are taken alike: the i-th goes with the i-th.
    takes = takes.withColumn("_copy", F.dense_rank().over(W.partitionBy(*same).orderBy("row")))
    takes = takes.select(*[F.col(c).alias(f"_{c}") for c in same], F.col("_copy").alias("_taken_copy"), "words")
    sized = docs.withColumn("_words", mixing.word_count(F.col("text")))
    order = F.xxhash64("text")
    numbered = sized.withColumn("_copy", F.row_number().over(W.partitionBy("doc_id", "source", "_words").orderBy(order)))
    on = (
        F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("_source"))
        & (F.col("_words") == F.col("_size"))
        & (F.col("_copy") == F.col("_taken_copy"))
    )
    taken = numbered.join(takes, on)
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + mixing.WORD), F.lit(0))
    cut = F.when(F.col("words") < F.col("_words"), F.array_join(F.slice(pieces, 1, F.col("words").cast("int")), ""))
    columns = {c: F.col(c) for c in docs.columns}
    columns["text"] = F.coalesce(cut, F.col("text"))
    if "n_chars" in columns:
        n_chars = F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("words") < F.col("_words"), n_chars).otherwise(F.col("n_chars"))
    return taken.select(*[column.alias(c) for c, column in columns.items()])


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name)
    return docs
