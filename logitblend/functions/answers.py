"""Answers and gold labels out of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logitblend.functions.text import (
    before_markers,
    clean_number,
    collapse_whitespace,
    cut_trailers,
    keep_numeric_chars,
    strip,
)

# A number, and the spellings of a final answer, most trusted first.
NUMBER = r"(-?\d+[.,]?\d*)"
ANSWER_PATTERNS = (
    r"####(?U:[\s\x1c-\x1f])*(-?\d+[.,]?\d*)",
    r"\\boxed\{(-?\d+[.,]?\d*)\}",
    r"the answer is (\d+)",
)
# The wider table, with currency amounts.
NUMBER_PATTERNS = (
    r"\\boxed\{(-?\d+[.,]?\d*)\}",
    r"####(?U:[\s\x1c-\x1f])*(-?\d+[.,]?\d*)",
    r"answer is (\d+)",
    r"[$€£]?(-?\d+[.,]?\d*)",
)
# The earlier rule's number.
EARLIER_NUMBER = r"(-?\d*[.,]?\d+)"
# Gold labels, choice markers and choice letters.
GOLD_PATTERN = r"(?iu)answer is (-?\d+)"
STRICT_GOLD_PATTERN = r"#### (-?\d+)"
LENIENT_GOLD_PATTERN = r"answer is (\d+)"
CHOICE_MARKERS = ("boxed", "the answer is ", "The answer is ")
CHOICE_LETTER = r"([A-D])"

_NAN = float("nan")


def _or_nan(number: Column) -> Column:
    return F.coalesce(number, F.lit(_NAN))


def _last_number(text: Column, pattern: str) -> Column:
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def extract_number(text: Column, patterns: Sequence[str] = ANSWER_PATTERNS) -> Column:
    """The last match of the first pattern that matches at all, else the last
    number in the text, else NaN.  Pass a column, not a long expression: each
    pattern reads it again.  Text cleaned by the whitelist has no marker left, so for it
    the last number alone will do: no patterns."""
    tries = [_last_number(text, p) for p in patterns]
    return _or_nan(F.coalesce(*tries, _last_number(text, NUMBER)))


def extract_number_after_marker(text: Column) -> Column:
    """The earlier rule: the last number behind the last marker."""
    tail, _ = _after_marker(text)
    return _or_nan(_last_number(tail, EARLIER_NUMBER))


def _after_marker(text: Column) -> tuple[Column, Column]:
    tail, found = text, F.lit(False)
    for marker in reversed(CHOICE_MARKERS):
        rest = F.substring_index(text, marker, -1)
        if marker.endswith(" "):
            rest = strip(rest)
        present = F.contains(text, F.lit(marker))
        tail = F.when(present, rest).otherwise(tail)
        found = present | found
    return tail, found


def extract_choice(text: Column) -> Column:
    """A choice letter: the first behind a marker, or the last of the text."""
    tail, found = _after_marker(text)
    first = _first(tail, CHOICE_LETTER)
    last = _first(tail, "(?s).*" + CHOICE_LETTER)
    return F.when(found, first).otherwise(last)


def _first(text: Column, pattern: str) -> Column:
    """First match or null.  Casting the empty string that means "no match" would
    cost a caught exception per row."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def has_gold_answer(answer: Column) -> Column:
    return F.rlike(answer, F.lit(GOLD_PATTERN))


def gold_label(answer: Column) -> Column:
    return _or_nan(clean_number(_first(answer, GOLD_PATTERN)).try_cast("double"))


def strict_gold_label(answer: Column, on_error: str = "nan") -> Column:
    number = _first(answer, STRICT_GOLD_PATTERN).try_cast("double")
    return _or_nan(number) if on_error == "nan" else _or_raise(number, answer)


def lenient_gold_label(answer: Column, on_error: str = "nan") -> Column:
    stated = _first(answer, LENIENT_GOLD_PATTERN).try_cast("double")
    number = F.coalesce(stated, _last_number(answer, r"(\d+)"))
    return _or_nan(number) if on_error == "nan" else _or_raise(number, answer)


def _or_raise(number: Column, answer: Column) -> Column:
    problem = F.concat(F.lit("no gold label in: "), F.substring(answer, 1, 200))
    return F.coalesce(number, F.raise_error(problem).cast("double"))


def clean_solution(output: Column, clean: str = "markers") -> Column:
    """The answer part of a generated text.

    ``markers`` cuts at the next question or explanation, ``question`` at the
    next question only, ``whitelist`` keeps only characters of numbers.
    """
    output = collapse_whitespace(output)
    if clean == "whitelist":
        return keep_numeric_chars(cut_trailers(output))
    return before_markers(output, explanation=clean == "markers")
