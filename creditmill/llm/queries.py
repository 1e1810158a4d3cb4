"""One registered query per operator: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from creditmill.llm.bpe_lexicon import round_trip
from creditmill.llm.ego_join import near_vectors
from creditmill.llm.line_dedup import line_report
from creditmill.llm.ngram_join import near_duplicates
from creditmill.llm.packing import packed_documents
from creditmill.llm.quality_rules import judged
from creditmill.llm.shallot import centroid_clusters
from creditmill.llm.span_dedup import span_report
from creditmill.llm.suffix_dedup import substring_report
from creditmill.llm.token_store import stored_tokens
from creditmill.llm.toxicity import toxicity
from creditmill.llm.warc import pages_from_archives
from creditmill.llm.whitening import whitening_report

#: The vocabulary's file; every operator takes its path as a parameter.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_from_archives(_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"), VOCABULARY)


def op7_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), VOCABULARY)


def op8_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(_table(spark, sf_dir, "embeddings"))


def op13_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_warc, op3_quality_rules, op4_ngram_join, op5_span_dedup, op6_packing, op7_bpe_lexicon, op8_ego_join, op9_token_store, op10_line_dedup,
    op11_suffix_dedup, op12_whitening, op13_shallot_clusters,
)}
