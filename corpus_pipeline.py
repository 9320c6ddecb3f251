"""From raw documents to training shards: five stages, each one of the operators of
``logitblend.llm``.

A stage takes (spark, documents, folder of the tables) and returns a DataFrame.  It is
written as Parquet, and what was written is the next stage's documents, so a lost
executor costs at most the stage it was in.  All stages but the last return the columns of
the documents they got.

Edge cases are those of the operators; a table without documents goes through all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logitblend.llm import decontam, mixing, quality, sharding, similar
from logitblend.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones, accepts."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, a similarity of 0.8."""
    return similar.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixture(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in random order, with their shard and their place in it."""
    return sharding.into_shards(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_stage),
]

# No SQL says what the classifier, the fingerprints or the shuffles compute; the tests
# compare every stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
