"""What the operators of this folder share: reading tables, words, hold-out rule, checkpoints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.sources.shared import cut_lineage, discard, shared_folder  # noqa: F401  for the operators

# The characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table.

    Arrow batches are kept small, since texts may be long. That is a setting of the session, and Spark has
    none for a single query: who calls an operator on other tables should set it too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores when the scan has fewer splits than that (a small single file).

    A table with enough splits stays as it is: its texts are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Deals a bounded sample to all cores, without planning it first to see how many splits it has."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def held_out(modulus: int, remainder: int) -> Column:
    """True where crc32 of the decimal doc_id leaves ``remainder``; false for a null doc_id."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` cuts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents to learn from, the same ones each time.

    Of repeated label rows the largest label counts, of repeated documents one. The ids drawn are at
    most ``limit``, so they may be broadcast.
    """
    drawn = labels.filter(F.col(label).isin(0, 1) & learn_from).groupBy("doc_id").agg(F.max(label).alias("y"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(
        F.max("y").alias("y"), F.max("text").alias("text")
    )
