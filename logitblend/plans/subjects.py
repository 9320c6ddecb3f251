"""A benchmark of many subjects in one pass: subject is a column, not a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logitblend.operators import fewshot, metrics
from logitblend.schemas import CHOICE4_ITEM
from logitblend.sources.jsonl import read_subjects


def prompts(spark: SparkSession, test_folder: str, shot_folder: str) -> DataFrame:
    """Few-shot prompts of all subjects present in both folders."""
    items = read_subjects(spark, test_folder, CHOICE4_ITEM)
    shots = read_subjects(spark, shot_folder, CHOICE4_ITEM)
    return fewshot.few_shot_prompts(items, shots)


def report(rows: DataFrame, order: str | None = None) -> dict[str, DataFrame]:
    """Accuracy per subject, running over subjects, their mean, and overall."""
    return {
        "subject": metrics.subject_accuracy(rows, order=order),
        "running": metrics.running_accuracy(rows, order=order),
        "average_running": metrics.average_running_accuracy(rows, order=order),
        "overall": metrics.macro_micro_accuracy(rows, order=order),
    }
