"""The corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``. An empty table runs
through to an empty result; what single rows with nulls get is said by each operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from grantlake.llm import packing, pii, quality_rules, simhash, toxicity
from grantlake.llm.common import discard, held_out, shared_folder, table

CACHED = 120_000  # pieces a worker keeps: the stages before have left less memory here than op4_best_fit_packing has


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; boilerplate lines go from the others.

    A short text isn't a bad one: of the fixed rules only the one on repeated words holds here, and a
    text must have a word. The limit of fifty words belongs to the contract of the query.
    """
    return quality_rules.clean(docs, min_words=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from the labels of rows not held out."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), held_out(4, 2))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts (five-word shingles, 0.8) stays, the one with the least doc_id."""
    return simhash.one_of_similar(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cached=CACHED)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Scores of trained models and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
