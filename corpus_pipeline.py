"""A training-data pipeline of five stages over ``documents``.

Each stage takes what the one before kept, judges all of it, and returns the
columns of its input; the last one adds the token ids. Rows are only dropped
where a stage's docstring says so. Between stages the documents are written as
Parquet into the shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, jaccard_join, language_id, secret_scan, sentencepiece_codec
from colloquy.llm.common import bounded_batches, saved, ship_package, within
from colloquy.llm.queries import MODEL
from colloquy.session import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without
    letters (all, where no document has a label)."""
    ship_package(spark)
    bounded_batches(spark)
    samples = language_id.learn(docs.where(~language_id.is_held_out()))
    told = language_id.identify(docs, samples, keep=True)
    return told.where(~language_id.rejected()).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of documents whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more: the one of
    least id. Where ids repeat or are null, rows are judged, not ids: each is
    numbered first, a row goes only if its own text is linked to the one that
    stays, and that is the least by id (null last), then by a hash of its text."""
    ship_package(spark)
    bounded_batches(spark)
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if again.isEmpty():
        found = jaccard_join.similar(docs, 5, 80, 100)
        dropped = found.where("id <> component_id").select(F.col("id").alias("doc_id"))
        return docs.join(within(dropped), "doc_id", "left_anti").select(docs.columns)
    # written once, the numbers stay what they are whatever task is run again
    rows = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = jaccard_join.similar(rows, 5, 80, 100, by="_row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row")
    several = found.join(found.groupBy("component_id").count().where("count > 1"), "component_id").select(F.col("id").alias("_row"), "component_id")
    several = rows.select("doc_id", "text", "_row").join(several, "_row").select("component_id", "_row", order.alias("o"))
    stays = several.groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o._row").alias("_row"))
    dropped = several.select("_row").join(stays, "_row", "left_anti")
    return rows.join(dropped, "_row", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item up to a fifth of its words
    edited."""
    ship_package(spark)
    bounded_batches(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets of every text; n_chars is that of the new text."""
    found = secret_scan.scan(docs)
    new = found.withColumn("text", secret_scan.masked(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        changed = F.size("spans") > 0
        new = new.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the SentencePiece ids of every text, verified."""
    ship_package(spark)
    bounded_batches(spark)
    return sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(MODEL))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: Neither the language model nor the edit search nor the tokenizer is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
