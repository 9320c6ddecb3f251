"""Cleaning and extraction on hand-made rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from logitblend.functions import answers, text

x = lambda: F.col("x")


def test_whitespace_class_is_pythons(spark):
    """All code points Python splits on, and no others."""
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, chr(c)) for c in points], "c int, s string").select(
        "c",
        F.rlike("s", F.lit("^" + text.WHITESPACE + "$")).alias("space"),
        F.rlike("s", F.lit("^" + text.NON_WHITESPACE + "$")).alias("other"),
        (text.strip(F.col("s")) == "").alias("stripped"),
    )
    for r in rows.collect():
        expected = chr(r["c"]).isspace()
        assert r["stripped"] == expected, hex(r["c"])
        if r["c"] not in (0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029):  # `$` stops before these
            assert r["space"] == expected and r["other"] != expected, hex(r["c"])


@pytest.mark.parametrize(
    "given",
    ["", " ", "a", "\u00a0 a\t b\u3000\n", "a\x1cb", "\u2028", "x\r\n\r\ny", " é\u2003ü "],
)
def test_collapse_strip_count(evaluate, given):
    assert evaluate(lambda: text.collapse_whitespace(x()), x=given) == " ".join(given.split())
    assert evaluate(lambda: text.strip(x()), x=given) == given.strip()
    assert evaluate(lambda: text.word_count(x()), x=given) == len(given.split())


@pytest.mark.parametrize(
    "given, whole, question_only",
    [
        ("4 Question: next", "4", "4"),
        ("A Question here ", "A Question here", "A Question here"),
        ("B Explanation: x Question: y", "B", "B Explanation: x"),
        (" plain ", " plain ", " plain "),
        ("Explanation first", "", "Explanation first"),
        ("Question: a Question: b", "", ""),
    ],
)
def test_cut_at_markers(evaluate, given, whole, question_only):
    assert evaluate(lambda: text.cut_at_markers(x()), x=given) == whole
    assert evaluate(lambda: text.cut_at_markers(x(), explanation=False), x=given) == question_only


def test_cut_trailers_ends_at_newline_only(evaluate):
    given = "a qUESTION: b\rc\u2028d\nkept expLANation: e"
    assert evaluate(lambda: text.cut_trailers(x()), x=given) == "a \nkept "


def test_keep_numeric_chars(evaluate):
    assert evaluate(lambda: answers.clean_solution(x(), "whitelist"), x="3 4") == "34"
    assert evaluate(lambda: text.keep_numeric_chars(x()), x="the 1,0e5 / -2.") == "e1,0e5/-2."


def test_clean_number(evaluate):
    assert evaluate(lambda: text.clean_number(x()), x=" 1, 234 ") == "1234"


@pytest.mark.parametrize("given, expected", [("Prince.", "Prince"), ("a", ""), ("", ""), ("a b .", "a b")])
def test_drop_last_char(evaluate, given, expected):
    assert evaluate(lambda: text.drop_last_char(x()), x=given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("▁a", "Ġa"), ("<0x0A>", "/n"), ("ĊĊ", "/n/n"), ("Ġb", "Ġb"), ("", "")],
)
def test_normalize_token(evaluate, given, expected):
    assert evaluate(lambda: text.normalize_token(x()), x=given) == expected


NUMBERS = [
    ("the answer is 3 and #### 5", 5.0),
    ("#### 1 then #### 2", 2.0),
    ("#### 1,234", 1234.0),
    ("-1,234.5", 5.0),
    ("it is 6.", 6.0),
    ("the answer is -3", -3.0),
    (r"\boxed{7} the answer is 8", 7.0),
    (r"\boxed{-7.25}", -7.25),
    ("the answer is 8 of 9", 8.0),
    ("The answer is 8 of 9", 9.0),
    ("####\u00a0\n 12", 12.0),
    ("none", math.nan),
    ("", math.nan),
    ("3d", 3.0),
]


@pytest.mark.parametrize("given, expected", NUMBERS)
def test_extract_number(evaluate, given, expected):
    got = evaluate(lambda: answers.extract_number(x()), x=given)
    assert got == expected or (math.isnan(got) and math.isnan(expected))


def test_number_table_takes_currency(evaluate):
    got = evaluate(lambda: answers.extract_number(x(), answers.NUMBER_PATTERNS), x="costs €12.5 now")
    assert got == 12.5


@pytest.mark.parametrize(
    "given, expected",
    [
        ("so boxed{B} or C", "B"),
        ("the answer is C, not D", "C"),
        ("The answer is D", "D"),
        ("A then\nB", "B"),
        ("boxed A the answer is B", "A"),
        ("none", None),
        ("the answer is nothing", None),
    ],
)
def test_extract_choice(evaluate, given, expected):
    assert evaluate(lambda: answers.extract_choice(x()), x=given) == expected


def test_gold_labels(evaluate):
    assert evaluate(lambda: answers.gold_label(x()), x="The ANSWER is -12, answer is 3") == -12.0
    assert evaluate(lambda: answers.gold_label(x()), x="answer is 1,234") == 1.0
    assert math.isnan(evaluate(lambda: answers.gold_label(x()), x="42"))
    assert evaluate(lambda: answers.strict_gold_label(x()), x="so\n#### -8") == -8.0
    assert math.isnan(evaluate(lambda: answers.strict_gold_label(x()), x="####8"))
    assert evaluate(lambda: answers.lenient_gold_label(x()), x="answer is 5 of 9") == 5.0
    assert evaluate(lambda: answers.lenient_gold_label(x()), x="Answer is 5 of 9") == 9.0


@pytest.mark.parametrize("rule", [answers.strict_gold_label, answers.lenient_gold_label])
def test_gold_label_can_raise(evaluate, rule):
    with pytest.raises(Exception, match="no gold label in: none"):
        evaluate(lambda: rule(x(), on_error="raise"), x="none")
    assert evaluate(lambda: rule(x(), on_error="raise"), x="#### 4") == 4.0


def test_patterns_agree_with_python(spark):
    """The same rules with Python's regex engine, over generated text."""
    import random

    rng = random.Random(7)
    parts = ["#### ", "\\boxed{", "}", "the answer is ", "12", "-3.5", "1,234", " ", "x", "7.", "\n"]
    given = ["".join(rng.choices(parts, k=8)) for _ in range(400)]

    def last(pattern, s):
        found = re.findall(pattern, s)
        return float(found[-1].replace(",", "")) if found else None

    number = r"(-?\d+[.,]?\d*)"
    rules = [r"####\s*" + number, r"\\boxed\{" + number + r"\}", r"the answer is (\d+)", number]
    rows = spark.createDataFrame([(s,) for s in given], "x string")
    got = [r["v"] for r in rows.select(answers.extract_number(x()).alias("v")).collect()]
    for s, v in zip(given, got):
        expected = next((n for n in (last(p, s) for p in rules) if n is not None), None)
        assert (math.isnan(v) and expected is None) or v == expected, s
