"""Metrics on hand-made rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from logitblend.operators import dedup, metrics
from logitblend.plans import evaluation

NAN = math.nan
MATH = "seq int, original_sln string, pred double, label double"
CHOICE = "seq int, question string, pred string, label string, subject string"


def one(df):
    assert df.count() == 1
    return df.first().asDict()


def test_nan_never_scores(spark):
    rows = spark.createDataFrame(
        [(1, "a", NAN, NAN), (2, "b", 1.0, NAN), (3, "c", 2.0, 2.0), (4, "d", None, 2.0)], MATH)
    got = one(metrics.math_accuracy(rows))
    assert got == {"num_q": 4, "correct": 1, "ratio": 0.25}


def test_first_row_of_a_question_wins(spark):
    rows = spark.createDataFrame(
        [(2, "a", 1.0, 1.0), (1, "a", 0.0, 1.0), (3, None, 5.0, 5.0), (4, None, 4.0, 5.0)], MATH)
    assert one(metrics.math_accuracy(rows)) == {"num_q": 2, "correct": 1, "ratio": 0.5}
    first = dedup.first_rows(rows, ["original_sln"]).collect()
    assert sorted(r["seq"] for r in first) == [1, 3]


def test_long_questions_are_told_apart(spark):
    """Long keys are grouped by digest; short ones, and a text that looks like
    the digest of a long one, stay what they are."""
    long = "x" * 5000
    keys = [long, long + "y", long, "short", hashlib.sha256(long.encode()).hexdigest(), "short"]
    rows = spark.createDataFrame(
        [(i, k, float(i), float(i)) for i, k in enumerate(keys)], MATH)
    assert one(metrics.math_accuracy(rows)) == {"num_q": 4, "correct": 4, "ratio": 1.0}


def test_empty_tables(spark):
    none = {"num_q": 0, "correct": 0, "ratio": None}
    assert one(metrics.math_accuracy(spark.createDataFrame([], MATH))) == none
    assert one(metrics.choice_accuracy(spark.createDataFrame([], CHOICE))) == none
    qa = spark.createDataFrame([], "pred string, label array<string>")
    assert one(metrics.qa_accuracy(qa)) == {**none, "n_empty": 0}


def test_choices_are_stripped(spark):
    rows = spark.createDataFrame(
        [(1, "q1", "\u00a0B\u3000", "\tB", "s"), (2, "q2", "B.", "B", "s"),
         (3, "q3", None, "B", "s")], CHOICE)
    assert one(metrics.choice_accuracy(rows)) == {"num_q": 3, "correct": 1, "ratio": 1 / 3}


def test_options_make_the_question(spark):
    """Same stem with other options is another question, the same row is not."""
    items = spark.createDataFrame(
        [(1, "q", "a", "b", "A"), (2, "q", "a", "c", "A"), (3, "q", "a", "b", "B")],
        "seq int, question string, A string, B string, answer string")
    rendered = evaluation.render(items, "choice2")
    rows = rendered.withColumn("output", F.lit(" A\nQuestion: no"))
    records = evaluation.records(rows, "choice2")
    assert one(evaluation.score(records, "choice2")) == {"num_q": 2, "correct": 2, "ratio": 1.0}


QA = [("Prince.", ["x", "Prince of X"]), ("", ["any"]), ("Prince", ["Prince"]), ("ab.", ["b"]),
      ("x.", [])]


@pytest.mark.parametrize("strict, correct", [(False, 3), (True, 2)])
def test_qa_accuracy(spark, strict, correct):
    rows = spark.createDataFrame(QA, "pred string, label array<string>")
    got = one(metrics.qa_accuracy(rows, empty_is_wrong=strict))
    assert got == {"num_q": 5, "correct": correct, "n_empty": 1, "ratio": correct / 5}


def test_qa_labels_may_be_text_or_list(spark):
    rows = spark.createDataFrame(
        [("Pri.", '"Prince"'), ("Pri.", '["no", "Prince"]'), ("r.", '"Prince"')],
        "pred string, raw string").select("pred", F.parse_json("raw").alias("label"))
    assert one(metrics.qa_accuracy(rows))["correct"] == 3
    assert one(metrics.qa_accuracy(rows, char_labels=True))["correct"] == 2
    text = rows.select("pred", F.col("label").cast("string"))
    assert one(metrics.qa_accuracy(text.filter("label = 'Prince'"), char_labels=True))["correct"] == 1


def test_numeric_metrics(spark):
    rows = spark.createDataFrame([(2.5, 2.0), (3.5, 4.0), (1.0, 1.0), (NAN, 1.0)],
                                 "pred double, label double")
    got = one(metrics.numeric_metrics(rows))
    assert got == {"n": 4, "accuracy": 0.75, "mae": 1.0 / 3, "exact_match": 0.25, "n_nan": 1}
    text = spark.createDataFrame([("2.5", "2"), ("1d", "1"), (" 4 ", "4.0"), ("x", "1")],
                                 "pred string, label string")
    got = one(metrics.numeric_metrics(text))
    assert got == {"n": 4, "accuracy": 0.5, "mae": 0.25, "exact_match": 0.25, "n_nan": 2}


def test_text_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("xax", "a"), ("a", "xax"), (None, "a")],
                                 "pred string, original_sln string")
    assert one(metrics.text_metrics(rows)) == {"n": 4, "exact_match": 0.25, "partial_match": 0.5}


def subject_rows(spark):
    data, seq = [], 0
    for subject, hits in {"beta": "10", "alpha": "1", "": "0", "bravo": "110", "Zeta": "1"}.items():
        for n, h in enumerate(hits):
            seq += 1
            data.append((seq, f"{subject}{n}", "A", "A" if h == "1" else "B", subject))
    data.append((99, "beta1", "A", "A", "alpha"))  # seen before, under beta
    return spark.createDataFrame(data, CHOICE)


def test_running_accuracy_equals_a_plain_loop(spark):
    rows = subject_rows(spark)
    per = {r["subject"]: (r["num_q"], r["correct"]) for r in metrics.subject_accuracy(rows).collect()}
    assert per == {"": (1, 0), "Zeta": (1, 1), "alpha": (1, 1), "beta": (2, 1), "bravo": (3, 2)}
    n = c = 0
    expected, ratios = {}, []
    for s in sorted(per):
        n, c = n + per[s][0], c + per[s][1]
        expected[s] = (n, c, c / n)
        ratios.append(c / n)
    got = {r["subject"]: (r["num_q_so_far"], r["correct_so_far"], r["acc_so_far"])
           for r in metrics.running_accuracy(rows).collect()}
    assert got == expected
    average = one(metrics.average_running_accuracy(rows))["avg_acc"]
    assert average == pytest.approx(sum(ratios) / len(ratios))
    overall = one(metrics.macro_micro_accuracy(rows))
    assert overall["macro_acc"] == pytest.approx((0 + 1 + 1 + 0.5 + 2 / 3) / 5)
    assert overall["micro_acc"] == pytest.approx(5 / 8)


def test_metrics_by_run(spark):
    rows = subject_rows(spark)
    twice = rows.withColumn("run", F.explode(F.array(F.lit("x"), F.lit("y"))))
    alone = sorted(map(str, metrics.running_accuracy(rows).collect()))
    for run in "xy":
        part = metrics.running_accuracy(twice, by=["run"]).filter(F.col("run") == run).drop("run")
        assert sorted(map(str, part.collect())) == alone


@pytest.mark.parametrize("gold, label", [("stated", 5.0), ("strict", 7.0), ("lenient", 5.0)])
def test_math_records(spark, gold, label):
    rows = spark.createDataFrame(
        [(1, "p", "the answer is 5 #### 7", "so  \\boxed{5}.\n Question: 9"),
         (2, "p", "the answer is 5 #### 7", "3 4 Explanation: 1")],
        "seq int, prompt string, answer string, output string")
    got = evaluation.records(rows, "math", gold).orderBy("seq").collect()
    assert [r["pred_solution"] for r in got] == ["so \\boxed{5}.", "3 4"]
    assert [(r["pred"], r["label"]) for r in got] == [(5.0, label), (4.0, label)]
    glued = evaluation.records(rows, "math", gold, clean="whitelist").orderBy("seq").collect()
    assert [r["pred"] for r in glued] == [5.0, 34.0]
    offline = one(evaluation.offline_metrics(evaluation.records(rows, "math", gold), "math"))
    assert offline["n"] == 2
