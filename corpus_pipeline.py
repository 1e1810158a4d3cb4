"""A corpus pipeline over ``documents``: every stage takes (spark, docs, sf_dir) and returns a table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.llm.common import stored
from creditmill.llm.line_dedup import drop_repeated_lines
from creditmill.llm.ngram_join import keep_one_of_each
from creditmill.llm.packing import packed_documents
from creditmill.llm.quality_rules import keep_good
from creditmill.llm.span_dedup import drop_repeated_spans


#: Bytes of rows that the JVM and a Python worker hand each other at once, about.
BATCH_BYTES = 1 << 22
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, from now on and for all its queries, unless its owner has done so.

    The stages run in the same executors, one after the other. With Spark's own bound of 64 MB a batch can be a
    whole partition of texts, and executors do not give back all memory that such batches took.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    _small_batches(spark)
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go."""
    return _recounted(drop_repeated_lines(docs))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays."""
    _small_batches(spark)
    return keep_one_of_each(docs)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go."""
    _small_batches(spark)
    return _recounted(drop_repeated_spans(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of 2048 tokens."""
    _small_batches(spark)
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("span_dedup", span_dedup),
    ("packing", packing),
]

#: Near copies and token ids have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
