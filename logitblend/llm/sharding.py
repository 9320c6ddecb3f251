"""Sharding by a two-pass external shuffle.

Pass one gives every record a seeded hash and writes records and hashes to the shared
folder.  Pass two deals them by hash into buckets of bounded size, draws one
Fisher-Yates permutation for each bucket, and lays the permuted buckets end to end.  The
shards are equal cuts of that sequence, so each bucket lies in one shard, or two at a cut.

Only DataFrame functions: records are numbered by a window that can spill, and the
Fisher-Yates step (``shuffle`` of SQL) permutes a bucket's numbers, not its records, so no
bucket is ever a value in memory.

Edge cases: a record without text has size 1; records of equal content are told apart
by their place in the input, so that copies spread over the buckets; no records give no rows; input
columns named ``shard`` or ``slot`` are replaced.  Pass one reads its input once, so a
task that is run again can't deal records differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logitblend.llm.common import fresh, integer, with_total_before, written

BUCKET_BYTES = 8 << 20
SHARDS = 8
SEED = 20_240_601


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text plus one for its end; a missing text has none."""
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 1


def into_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``docs`` in random order: its columns, then ``shard`` (0 to ``shards`` - 1, row
    counts at most one apart) and ``slot`` (0, 1, ... in each shard)."""
    docs = docs.drop("shard", "slot")
    dealt, number, bucket, start, rows, moved, place = fresh(
        docs, "dealt", "number", "bucket", "start", "bucket_rows", "moved", "place"
    )
    scattered = written(
        docs.withColumn(
            dealt, F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id())
        ),
        "scattered",
    )
    total = scattered.agg(F.sum(record_size(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n, n_buckets = total["n"], max(1, -(-integer(total["b"]) // bucket_bytes))
    scattered = scattered.withColumn(bucket, F.pmod(F.col(dealt), F.lit(n_buckets)))

    # One row for each bucket: where it starts in the sequence, and its permutation.
    counts = scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias(rows))
    plan = with_total_before(counts, bucket, rows, start).select(
        bucket,
        start,
        F.shuffle(F.sequence(F.lit(1), F.col(rows).cast("int")), seed).alias(moved),
    )
    numbered = scattered.withColumn(
        number, F.row_number().over(Window.partitionBy(bucket).orderBy(dealt))
    )
    placed = numbered.join(plan, bucket).withColumn(
        place, F.col(start) + F.element_at(moved, F.col(number)) - 1
    )
    # The first `longer` shards have one row more than the others.
    each, longer = divmod(n, shards)
    ahead, at = longer * (each + 1), F.col(place)
    inside = at < ahead
    shard = F.when(inside, F.floor(at / (each + 1))).otherwise(
        longer + F.floor((at - ahead) / max(each, 1))
    )
    slot = F.when(inside, at % (each + 1)).otherwise((at - ahead) % max(each, 1))
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=k`` for each shard, records in order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
