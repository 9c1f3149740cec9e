"""A training-data pipeline over `documents`: quality rules, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
documents, whatever there are besides doc_id and text. Rows are told by doc_id and text: a null doc_id is the largest, and rows that
share one are apart unless their texts are near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontaminate import decontaminate
from millrace.llm.jaccard_join import one_of_each_class
from millrace.llm.quality import keep_good
from millrace.llm.secret_scan import redact
from millrace.llm.sentencepiece_codec import encoded_and_decoded
from millrace.llm.shared import materialise

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row of the least doc_id."""
    return one_of_each_class(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each document."""
    return encoded_and_decoded(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("sentencepiece", tokens),
]

#: Secret scanning and tokenizing can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
