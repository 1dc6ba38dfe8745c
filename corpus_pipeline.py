"""Corpus pipeline: toxicity, exact and near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. ``run`` writes
each stage's rows to the shared folder and reads them again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lateline.llm import decontamination, exact_dedup, mixing, simhash, toxicity
from lateline.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.keep_first_of_equal(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts joined by fingerprints at most two bits apart the document with the smallest doc_id."""
    return simhash.keep_one_per_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs, benchmark)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixture(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies),
          ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_leaks),
          ("mixing", mix)]

#: A trained network's scores have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
