"""Prompt rendering: one string expression per question-set kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the prompts.
TWO_CHOICE_HEAD = "Answer the question by replying A or B.\n"
FOUR_CHOICE_HEAD = "Answer the question by replying A, B, C or D.\n"
STEPWISE_TAIL = "\nLet's think step by step\n"
# The character before "oxed" is a backspace, as in the original wording.
BOXED_REQUEST = "\n请逐步思考，并通过\boxed{}给出最终数值答案\n\n"


def _question_with_options(letters: str) -> Column:
    parts = [F.lit("Question: "), F.col("question")]
    for letter in letters:
        parts += [F.lit(f"\n{letter}: "), F.col(letter)]
    return F.concat(*parts)


def two_choice() -> Column:
    return F.concat(F.lit(TWO_CHOICE_HEAD), _question_with_options("AB"), F.lit("\nAnswer:"))


def four_choice() -> Column:
    return F.concat(F.lit(FOUR_CHOICE_HEAD), _question_with_options("ABCD"), F.lit("\nAnswer:"))


def worked_example() -> Column:
    """One solved four-choice item of a few-shot block."""
    return F.concat(
        _question_with_options("ABCD"), F.lit("\nAnswer: "), F.col("answer"), F.lit("\n\n")
    )


def few_shot_four_choice(block: Column) -> Column:
    return F.concat(block, four_choice())


def open_qa(prompt: str) -> Column:
    return F.concat(F.lit(prompt + "\n\nQuestion: "), F.col("question"), F.lit("\nAnswer:"))


def math(prompt: str, style: str = "plain") -> Column:
    """``doubled`` repeats the prompt file and adds the boxed-answer request."""
    head = prompt * 2 + BOXED_REQUEST if style == "doubled" else prompt + "\n\n"
    return F.concat(F.lit(head + "Question: "), F.col("question"), F.lit(STEPWISE_TAIL))
