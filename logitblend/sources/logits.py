"""Storage of logged logits.

A blend needs each vector twice: for its top k, and for the tokens other models
propose.  In a table written here all vectors of a step lie in the same bucket,
so neither vectors nor candidates are shuffled, and the top k is a narrow column
of its own, so the vectors are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logitblend.functions import half, vectors
from logitblend.operators.candidates import faulty_keys
from logitblend.schemas import STEP_KEYS

#: A scan decodes up to 4,096 rows of a row group at a time, which for vectors of
#: 128,000 floats is 2 GB per task.  Small row groups bound it for any reader.
ROW_GROUP_BYTES = 32 << 20


def write_bucketed(
    logits: DataFrame, table: str, buckets: int, path: str | None = None, k: int = 10
) -> None:
    """Write dense logits (arrays, or packed by ``functions.half``) bucketed by step, with the ranked top k of
    each vector in ``top_<k>``.

    The one shuffle of the wide rows happens here, once, instead of in every
    query.  Size buckets so that one holds about 1 GB.  A step logged twice by one
    model is refused: which vector counts is not ours to say."""
    fault = faulty_keys(logits).first()
    if fault is not None:
        raise ValueError(f"not one vector per step and model: {fault.asDict()}")
    ranked = logits.withColumn(f"top_{k}", half.over_vector(logits, lambda v: vectors.top_k(v, k)))
    writer = (
        ranked.repartition(buckets, *STEP_KEYS)
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, *STEP_KEYS)
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
    )
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
