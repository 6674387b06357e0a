"""A training corpus from raw documents, in stages that can run and be read one by one.

``documents`` go through a quality filter, near-duplicate removal, benchmark
decontamination, mixing to target weights and sharding.  Every stage works on
all rows the one before it kept, and is written as Parquet before the next.
Null and empty texts go at the first stage, which scores them 0; an empty table
stays empty; rows that share an id are judged by each of their texts and count
as near duplicates of each other only if their texts are; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontaminate, mixing, quality, sharding, simhash
from lexmill.session import materialize, ship_package


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learned from ``labels``, scores below 0.5."""
    ship_package(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of texts whose four-word fingerprints are linked over 4 or fewer bits."""
    ship_package(spark)
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least 0.8 of the word shingles of a ``benchmark`` item."""
    ship_package(spark)
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until the sources have their target shares."""
    ship_package(spark)
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals all documents to shards along a Hilbert curve through their metadata."""
    ship_package(spark)
    return sharding.hilbert_shards(docs)


STAGES = [
    ("good_quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mix", mix),
    ("shard", shard),
]

# SQL has neither the trained model nor the hashes of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
