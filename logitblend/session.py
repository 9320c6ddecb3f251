"""Session settings the jobs are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan with measured sizes: merge small partitions, split skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A step's join keys may be partitioned by fewer columns than joined on.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # The JVM does not compile methods beyond this size; many patterns in one
    # projection make such methods.  Smaller ones are generated instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}

# For scanning vocabulary-sized vectors from files with large row groups: rows are
# decoded in batches, and a batch of the usual 4,096 takes gigabytes per task.
# Tables written by ``sources.logits`` do not need it.
WIDE_VECTOR_SETTINGS = {
    "spark.sql.parquet.columnarReaderBatchSize": "64",
    "spark.sql.files.maxPartitionBytes": "1g",
}


def apply_settings(
    builder: SparkSession.Builder, wide_vectors: bool = False
) -> SparkSession.Builder:
    """Add the settings to a session builder; later ``config`` calls win."""
    for key, value in (SETTINGS | (WIDE_VECTOR_SETTINGS if wide_vectors else {})).items():
        builder = builder.config(key, value)
    return builder
