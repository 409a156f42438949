"""A corpus pipeline over `documents`: five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  Documents that a filter rejects
are gone; texts that a stage changes stay changed.

Cases, in every stage: a null or empty text has no words, so the quality rules reject it and later stages leave it as it is.
Rows without doc_id are judged by the quality rules and by decontamination, and kept as they are by the two dedups.
Repeated rows are kept or go together.  Columns of any name are carried along, whatever they clash with, and only
doc_id, text and n_chars mean something.  An empty table gives an empty table.  Very long texts go through whole.

Each stage lowers the session's spark.sql.execution.arrow.maxRecordsPerBatch to shared.BATCH, for the executors' memory, and leaves it so,
as what it returns runs later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe_stream, dart_minhash, decontaminate, quality_bands, substring_dedup
from plumbline.llm.shared import small_batches, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie outside the compression bands."""
    small_batches(spark)
    return quality_bands.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate class."""
    small_batches(spark)
    return dart_minhash.deduped(docs)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of windows that a smaller doc_id has; n_chars follows the text."""
    small_batches(spark)
    return substring_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every remaining document."""
    small_batches(spark)
    return bpe_stream.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_removal),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: SQL can't express the compression bands and the signatures; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
