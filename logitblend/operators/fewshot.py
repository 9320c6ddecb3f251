"""Few-shot blocks per subject and their join to test items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logitblend.functions import prompts
from logitblend.functions.answers import has_gold_answer


def few_shot_blocks(shots: DataFrame, order: str = "seq") -> DataFrame:
    """One text per subject: its worked examples in file order.

    A block holds every example of its subject, as a prompt does.  :func:`shot_counts`
    tells how many those are."""
    examples = F.struct(F.col(order).alias("seq"), prompts.worked_example().alias("text"))
    return shots.groupBy("subject").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(examples)), lambda e: e["text"]), ""
        ).alias("few_shot")
    )


def shot_counts(shots: DataFrame) -> DataFrame:
    """Worked examples of each subject, and the bytes of their block."""
    return shots.groupBy("subject").agg(
        F.count(F.lit(1)).alias("shots"),
        F.sum(F.octet_length(prompts.worked_example())).alias("bytes"),
    )


def few_shot_prompts(items: DataFrame, shots: DataFrame, order: str = "seq") -> DataFrame:
    """Test items with their rendered few-shot prompt.  Subjects without test
    items or without worked examples drop out."""
    return (
        items.join(few_shot_blocks(shots, order), "subject")
        .withColumn("prompt", prompts.few_shot_four_choice(F.col("few_shot")))
        .drop("few_shot")
    )


def odd_gold_answers(items: DataFrame) -> DataFrame:
    """Items whose answer states no number in the expected form."""
    return items.filter(~has_gold_answer(F.col("answer")))
