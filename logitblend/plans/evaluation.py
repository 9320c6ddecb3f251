"""From question sets and generated texts to result records and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logitblend.functions import answers, prompts
from logitblend.operators import metrics

GOLD_RULES = {
    "stated": answers.gold_label,
    "strict": answers.strict_gold_label,
    "lenient": answers.lenient_gold_label,
}


def render(items: DataFrame, task: str, prompt: str = "", style: str = "plain") -> DataFrame:
    """Question items with their prompt text in ``prompt``."""
    renderers = {
        "choice2": prompts.two_choice,
        "choice4": prompts.four_choice,
        "qa": lambda: prompts.open_qa(prompt),
        "math": lambda: prompts.math(prompt, style),
    }
    return items.withColumn("prompt", renderers[task]())


def records(
    outputs: DataFrame,
    task: str,
    gold: str = "stated",
    clean: str = "markers",
    extra: Sequence[str | Column] = ("seq",),
) -> DataFrame:
    """Result records from rows with ``prompt``, ``answer`` and generated ``output``."""
    solution = answers.clean_solution(F.col("output"), clean)
    rows = outputs.select(
        *extra,
        F.col("prompt").alias("question"),
        F.col("answer").alias("original_sln"),
        solution.alias("pred_solution"),
    )
    if task == "math":
        patterns = () if clean == "whitelist" else answers.ANSWER_PATTERNS
        pred = answers.extract_number(F.col("pred_solution"), patterns)
        label = GOLD_RULES[gold](F.col("original_sln"))
    else:
        pred, label = F.col("pred_solution"), F.col("original_sln")
    return rows.withColumn("pred", pred).withColumn("label", label)


def score(rows: DataFrame, task: str, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Accuracy of result records by the rule of their task."""
    if task == "math":
        return metrics.math_accuracy(rows, by, order)
    if task == "qa":
        return metrics.qa_accuracy(rows, by)
    return metrics.choice_accuracy(rows, by, order)


def offline_metrics(rows: DataFrame, task: str, by: Sequence[str] = ()) -> DataFrame:
    return metrics.numeric_metrics(rows, by) if task == "math" else metrics.text_metrics(rows, by)
