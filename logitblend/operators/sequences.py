"""Token sequences: assembling picks and padding batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logitblend.functions import vectors
from logitblend.functions.text import collapse_whitespace, token_text


def gaps(steps: Column, first: Column | int = 0, last: Column | None = None) -> Column:
    """Runs of numbers that sorted distinct ``steps`` lack, as ``array<struct<start, stop>>`` with both ends
    missing, from ``first`` on, and up to ``last`` where it is known."""
    ends = [F.array((F.lit(first) - 1).cast("bigint")), F.transform(steps, lambda s: s.cast("bigint"))]
    if last is not None:
        ends.append(F.filter(F.array((last + 1).cast("bigint")), lambda s: s.isNotNull()))
    return vectors.bind(
        F.concat(*ends),
        lambda all_: F.filter(
            F.zip_with(
                F.slice(all_, 1, F.size(all_) - 1),
                F.slice(all_, 2, F.size(all_)),
                lambda a, b: F.struct((a + 1).alias("start"), (b - 1).alias("stop")),
            ),
            lambda g: g["start"] <= g["stop"],
        ),
    )


def assemble(
    picks: DataFrame,
    by: Sequence[str] = ("run", "example_id"),
    step: str = "step",
    token_id: str | None = "token_id_1",
    token: str = "next_token",
    expected: int | None = None,
) -> DataFrame:
    """One row per example with its ids in step order and the readable text.

    Picks have one row per step, so a group is as long as its example.  Where the
    picks have a ``special`` column, special tokens keep their ids but are no text.

    A log may lack steps, or hold one twice.  Where steps are integers, ``missing_steps`` are the runs of steps from zero on that have no pick
    (up to ``expected`` of them, where a run's length is known; else up to the last pick), and
    ``n_missing`` how many steps that is; ``repeated_steps`` are those with several picks."""
    readable = token_text(F.col(token))
    if "special" in picks.columns:
        readable = F.when(F.col("special"), F.lit("")).otherwise(readable)
    entry = [F.col(step).alias("step"), readable.alias("token")]
    if token_id is not None:
        entry.append(F.col(token_id).alias("id"))
    steps = F.array_sort(F.collect_list(F.struct(*entry)))
    grouped = picks.groupBy(*by).agg(steps.alias("steps"))
    text = F.array_join(F.transform("steps", lambda s: s["token"]), "")
    ids = (
        [F.transform("steps", lambda s: s["id"]).alias("token_ids")]
        if token_id is not None
        else []
    )
    plain = [
        F.size("steps").alias("n_steps"),
        *ids,
        collapse_whitespace(text).alias("text"),
    ]
    if not isinstance(picks.schema[step].dataType, T.IntegralType):
        return grouped.select(*by, *plain)
    numbers = F.transform("steps", lambda s: s["step"])
    known = F.filter(F.array_distinct(numbers), lambda s: s.isNotNull() & (s >= 0))
    if expected is not None:
        known = F.filter(known, lambda s: s < expected)
    missing = gaps(known, 0, None if expected is None else F.lit(expected - 1))
    before = F.transform(numbers, lambda s, i: F.when(F.get(numbers, i - 1) == s, s))
    repeated = F.array_distinct(F.filter(before, lambda s: s.isNotNull()))
    length = F.aggregate(
        "missing_steps", F.lit(0).cast("bigint"), lambda n, g: n + g["stop"] - g["start"] + 1
    )
    return grouped.select(
        *by, *plain, missing.alias("missing_steps"), repeated.alias("repeated_steps")
    ).withColumn("n_missing", length)


def left_pad(
    sequences: DataFrame, batch: str = "batch_id", ids: str = "ids", pad_id: int = 0
) -> DataFrame:
    """Pad every sequence of a batch on the left to the batch's longest, with a mask.  A missing batch
    is a batch, and missing ids are none.

    The longest length is an aggregate per batch joined back: a window over the
    batch would bring a large batch into one task.  The planner picks the join by the
    size of the lengths, and splits a hot batch."""
    kind = sequences.schema[ids].dataType.simpleString()
    own = F.coalesce(F.col(ids), F.array().cast(kind))
    lengths = sequences.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.size(own)).alias("width"))
    padded = sequences.join(lengths, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
    return padded.withColumn("mask", vectors.left_pad_mask(own, F.col("width"))).withColumn(
        "padded", vectors.left_pad(own, F.col("width"), pad_id)
    )
