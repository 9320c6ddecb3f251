"""Accuracy and error metrics over result rows derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logitblend.operators import dedup, metrics
from logitblend.plans import evaluation
from logitblend.sources import jsonl
from logitblend.sources.shared import shared_folder
from logitblend.workload.inputs import table

NAN = float("nan")


def _rounded(column: str) -> Column:
    return F.round(column, 6).alias(column)


def _letter(base: int) -> Column:
    return F.char(F.lit(65) + F.col("o_orderkey") % base)


def choice_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("Q"), "o_custkey").alias("question"),
        F.col("o_orderpriority").alias("subject"),
        F.concat(F.lit(" \u00a0"), _letter(3), F.lit("\t\n")).alias("pred"),
        F.concat(_letter(4), F.lit(" ")).alias("label"),
    )


SQL_CHOICE = """
WITH results AS (
  SELECT o_orderkey AS seq, 'Q' || o_custkey AS question, o_orderpriority AS subject,
         o_orderkey % 3 = o_orderkey % 4 AS hit
  FROM orders),
first AS (
  SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY question ORDER BY seq) = 1)
"""


def math_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    label = (key % 50).cast("double")
    off = (key % 3 - 1) * F.lit(0.5)
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        "o_orderstatus",
        F.concat(F.lit("W"), "o_custkey").alias("original_sln"),
        F.when(key % 11 == 0, F.lit(NAN)).otherwise(label + off).alias("pred"),
        F.when(key % 22 == 0, F.lit(NAN)).otherwise(label).alias("label"),
    )


SQL_MATH = """
WITH results AS (
  SELECT o_orderkey AS seq, o_orderstatus, 'W' || o_custkey AS original_sln,
         o_orderkey % 11 <> 0 AND o_orderkey % 3 = 1 AS hit
  FROM orders)
"""


def _accuracy_columns(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, "num_q", "correct", _rounded("ratio"))


SQL_ACCURACY = """count(*) AS num_q, count(*) FILTER (WHERE hit) AS correct,
       round(avg(hit::INTEGER), 6) AS ratio"""


def math_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy_columns(metrics.math_accuracy(math_results(spark, sf_dir)))


MATH_ACCURACY = SQL_MATH + f""",
first AS (
  SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY original_sln ORDER BY seq) = 1)
SELECT {SQL_ACCURACY} FROM first
"""


def math_accuracy_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = math_results(spark, sf_dir).withColumnRenamed("o_orderstatus", "run")
    return _accuracy_columns(metrics.math_accuracy(rows, by=["run"]), "run")


MATH_ACCURACY_BY_RUN = SQL_MATH + f""",
first AS (
  SELECT * FROM results
  QUALIFY row_number() OVER (PARTITION BY o_orderstatus, original_sln ORDER BY seq) = 1)
SELECT o_orderstatus AS run, {SQL_ACCURACY} FROM first GROUP BY o_orderstatus
"""


def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy_columns(metrics.choice_accuracy(choice_results(spark, sf_dir)))


CHOICE_ACCURACY = SQL_CHOICE + f"SELECT {SQL_ACCURACY} FROM first"


def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole first rows, not only their scores."""
    return dedup.first_rows(choice_results(spark, sf_dir), ["question"])


FIRST_QUESTIONS = """
SELECT o_orderkey AS seq, 'Q' || o_custkey AS question, o_orderpriority AS subject,
       ' ' || chr(160) || chr((65 + o_orderkey % 3)::INTEGER) || chr(9) || chr(10) AS pred,
       chr((65 + o_orderkey % 4)::INTEGER) || ' ' AS label
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1
"""


def qa_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    pred = F.when(F.col("p_partkey") % 13 == 0, F.lit("")).otherwise(
        F.concat(
            F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(
                F.substring(words[0], 1, 3)
            ),
            F.lit(" ."),
        )
    )
    return table(spark, sf_dir, "part").select(
        "p_type", pred.alias("pred"), words.alias("label"), F.col("p_name").alias("gold_text")
    )


SQL_QA = r"""
WITH results AS (
  SELECT p_type, p_name, string_split(p_name, ' ') AS label,
         CASE WHEN p_partkey % 13 = 0 THEN ''
              WHEN p_partkey % 3 = 0 THEN p_brand
              ELSE substring(split_part(p_name, ' ', 1), 1, 3) END AS text
  FROM part),
judged AS (
  SELECT *, text = '' AS empty,
         len(list_filter(label, lambda g: contains(g, text))) > 0 AS hit,
         contains(p_name, text) AS text_hit,
         len(list_filter(string_split(p_name, ''), lambda g: contains(g, text))) > 0 AS char_hit
  FROM results)
"""


def qa_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = metrics.qa_accuracy(qa_results(spark, sf_dir), by=["p_type"])
    return by_type.select("p_type", "num_q", "correct", "n_empty", _rounded("ratio"))


QA_ACCURACY = SQL_QA + """
SELECT p_type, count(*) AS num_q, count(*) FILTER (WHERE hit) AS correct,
       count(*) FILTER (WHERE empty) AS n_empty, round(avg(hit::INTEGER), 6) AS ratio
FROM judged GROUP BY p_type
"""


def qa_accuracy_text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are plain strings: taken whole, by character, and with empty
    predictions counted as wrong."""
    rows = qa_results(spark, sf_dir).withColumn("label", F.col("gold_text"))
    modes = {
        "whole": metrics.qa_accuracy(rows),
        "characters": metrics.qa_accuracy(rows, char_labels=True),
        "no_empty": metrics.qa_accuracy(rows, empty_is_wrong=True),
    }
    parts = [
        df.select(F.lit(mode).alias("mode"), "num_q", "correct", "n_empty", _rounded("ratio"))
        for mode, df in modes.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QA_ACCURACY_TEXT_LABELS = SQL_QA + """,
modes AS (
  SELECT 'whole' AS mode, text_hit AS hit, empty FROM judged
  UNION ALL SELECT 'characters', char_hit, empty FROM judged
  UNION ALL SELECT 'no_empty', text_hit AND NOT empty, empty FROM judged)
SELECT mode, count(*) AS num_q, count(*) FILTER (WHERE hit) AS correct,
       count(*) FILTER (WHERE empty) AS n_empty, round(avg(hit::INTEGER), 6) AS ratio
FROM modes GROUP BY mode
"""


def numeric_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = (F.col("l_linenumber") % 3 - 1) * F.lit(0.5)
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.col("l_quantity").alias("label"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit(NAN))
        .otherwise(F.col("l_quantity") + off)
        .alias("pred"),
    )
    return metrics.numeric_metrics(rows, by=["l_returnflag"]).select(
        "l_returnflag", "n", "n_nan",
        *[_rounded(c) for c in ("accuracy", "mae", "exact_match")],
    )


NUMERIC_METRICS = """
WITH results AS (
  SELECT l_returnflag, l_quantity AS label, l_partkey % 11 <> 0 AS known,
         l_quantity + (l_linenumber % 3 - 1) * 0.5::DOUBLE AS pred
  FROM lineitem)
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE NOT known) AS n_nan,
       round(avg((known AND round_even(pred, 0) = label)::INTEGER), 6) AS accuracy,
       round(avg(CASE WHEN known THEN abs(label - pred) END), 6) AS mae,
       round(avg((known AND pred = label)::INTEGER), 6) AS exact_match
FROM results GROUP BY l_returnflag
"""


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns judged against the first words of their conversation's role."""
    gold = (
        F.when(F.col("turn") % 3 == 0, F.col("text"))
        .when(F.col("turn") % 3 == 1, F.element_at(F.split("text", " "), -1))
        .otherwise(F.lit("zebra"))
    )
    rows = table(spark, sf_dir, "conversations").select(
        "role", F.col("text").alias("pred"), gold.alias("original_sln")
    )
    return metrics.text_metrics(rows, by=["role"]).select(
        "role", "n", _rounded("exact_match"), _rounded("partial_match")
    )


TEXT_METRICS = """
WITH results AS (
  SELECT role, text AS pred, CASE turn % 3
    WHEN 0 THEN text WHEN 1 THEN list_last(string_split(text, ' ')) ELSE 'zebra' END AS gold
  FROM conversations)
SELECT role, count(*) AS n, round(avg((pred = gold)::INTEGER), 6) AS exact_match,
       round(avg(contains(pred, gold)::INTEGER), 6) AS partial_match
FROM results GROUP BY role
"""


def subject_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = choice_results(spark, sf_dir)
    return _accuracy_columns(metrics.subject_accuracy(rows), "subject")


SUBJECT_ACCURACY = SQL_CHOICE + f"SELECT subject, {SQL_ACCURACY} FROM first GROUP BY subject"


def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.running_accuracy(choice_results(spark, sf_dir)).select(
        "subject", "num_q_so_far", "correct_so_far", _rounded("acc_so_far")
    )


SQL_RUNNING = SQL_CHOICE + """,
subjects AS (
  SELECT subject, count(*) AS n, count(*) FILTER (WHERE hit) AS c FROM first GROUP BY subject),
running AS (
  SELECT subject, (sum(n) OVER (ORDER BY subject))::BIGINT AS num_q_so_far,
         (sum(c) OVER (ORDER BY subject))::BIGINT AS correct_so_far
  FROM subjects)
"""
RUNNING_ACCURACY = SQL_RUNNING + """
SELECT *, round(correct_so_far / num_q_so_far, 6) AS acc_so_far FROM running
"""


def average_running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_running_accuracy(choice_results(spark, sf_dir)).select(
        _rounded("avg_acc")
    )


AVERAGE_RUNNING_ACCURACY = SQL_RUNNING + """
SELECT round(avg(correct_so_far / num_q_so_far), 6) AS avg_acc FROM running
"""


def macro_micro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_micro_accuracy(choice_results(spark, sf_dir)).select(
        "n_subjects", "num_q", "correct", _rounded("macro_acc"), _rounded("micro_acc")
    )


MACRO_MICRO_ACCURACY = SQL_CHOICE + """,
subjects AS (
  SELECT subject, count(*) AS n, count(*) FILTER (WHERE hit) AS c FROM first GROUP BY subject)
SELECT count(*) AS n_subjects, sum(n)::BIGINT AS num_q, sum(c)::BIGINT AS correct,
       round(avg(c / n), 6) AS macro_acc, round(sum(c) / sum(n), 6) AS micro_acc
FROM subjects
"""


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated solutions of orders seen as math problems, repeated per customer."""
    key, n = F.col("o_orderkey"), (F.col("o_orderkey") % 50).cast("string")
    style = key % 4
    output = (
        F.when(style == 0, F.concat(F.lit("We  add.\n#### "), n))
        .when(style == 1, F.concat(F.lit("so \\boxed{"), n, F.lit("}\nQuestion: 77?")))
        .when(style == 2, F.concat(F.lit("the answer is "), n, F.lit(". Explanation: 5")))
        .otherwise(F.lit("cannot tell"))
    )
    answer = F.concat(F.col("o_custkey"), F.lit(" orders; the answer is "), n)
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        F.concat(F.lit("Order "), "o_custkey").alias("question"),
        answer.alias("answer"),
        output.alias("output"),
    )


def evaluation_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered prompts, result records and their metrics in one plan."""
    items = evaluation.render(_outputs(spark, sf_dir), "math", "Think.")
    records = evaluation.records(items, "math", gold="lenient")
    return records.select(
        "seq", "question", "pred_solution",
        F.nanvl("pred", F.lit(-1.0)).alias("pred"),
        F.nanvl("label", F.lit(-1.0)).alias("label"),
    )


EVALUATION_MATH = r"""
SELECT o_orderkey AS seq,
       'Think.' || chr(10) || chr(10) || 'Question: Order ' || o_custkey || chr(10)
       || 'Let''s think step by step' || chr(10) AS question,
       CASE o_orderkey % 4
         WHEN 0 THEN 'We add. #### ' || o_orderkey % 50
         WHEN 1 THEN 'so \boxed{' || o_orderkey % 50 || '}'
         WHEN 2 THEN 'the answer is ' || o_orderkey % 50 || '.'
         ELSE 'cannot tell' END AS pred_solution,
       CASE WHEN o_orderkey % 4 < 3 THEN (o_orderkey % 50)::DOUBLE ELSE -1::DOUBLE END AS pred,
       (o_orderkey % 50)::DOUBLE AS label
FROM orders
"""


def evaluation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = evaluation.render(_outputs(spark, sf_dir), "math", "Think.")
    records = evaluation.records(items, "math")
    return _accuracy_columns(evaluation.score(records, "math"))


EVALUATION_SCORE = f"""
WITH results AS (
  SELECT o_orderkey AS seq, o_custkey, o_orderkey % 50 AS n, o_orderkey % 4 < 3 AS hit FROM orders),
first AS (
  SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY o_custkey, n ORDER BY seq) = 1)
SELECT {SQL_ACCURACY} FROM first
"""


def evaluation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a choice task: the label is the answer as it stands."""
    items = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("Order of "), "o_custkey", F.lit("?")).alias("question"),
        F.col("o_orderpriority").alias("A"),
        F.col("o_orderstatus").alias("B"),
        _letter(2).alias("answer"),
        F.concat(F.lit(" "), _letter(3), F.lit(" \nQuestion: A?")).alias("output"),
    )
    records = evaluation.records(evaluation.render(items, "choice2"), "choice")
    return records.select("seq", "question", "original_sln", "pred", "label")


EVALUATION_CHOICE = """
SELECT o_orderkey AS seq,
       'Answer the question by replying A or B.' || chr(10) || 'Question: Order of ' || o_custkey
       || '?' || chr(10) || 'A: ' || o_orderpriority || chr(10) || 'B: ' || o_orderstatus
       || chr(10) || 'Answer:' AS question,
       chr(65 + (o_orderkey % 2)::INTEGER) AS original_sln,
       chr(65 + (o_orderkey % 3)::INTEGER) AS pred, chr(65 + (o_orderkey % 2)::INTEGER) AS label
FROM orders
"""


def _qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"),
        F.concat(F.lit("What is part "), "p_partkey", F.lit("?")).alias("question"),
        F.split("p_name", " ").alias("answer"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("p_partkey") % 7 == 0, "")
        .when(F.col("p_partkey") % 5 == 0, "zzz.\nQuestion: no")
        .otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".\nQuestion: no")))
        .alias("output"),
    )
    return evaluation.records(evaluation.render(items, "qa", "Name it."), "qa")


def evaluation_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an open question: the label is the list of aliases as it stands."""
    return _qa_records(spark, sf_dir).select(
        "seq", "question", "pred", F.array_join("label", "+").alias("label")
    )


EVALUATION_QA = """
SELECT p_partkey AS seq,
       'Name it.' || chr(10) || chr(10) || 'Question: What is part ' || p_partkey || '?'
       || chr(10) || 'Answer:' AS question,
       CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN ''
            WHEN p_partkey % 5 = 0 THEN 'zzz.' ELSE split_part(p_name, ' ', 1) || '.' END AS pred,
       replace(p_name, ' ', '+') AS label
FROM part
"""


def evaluation_qa_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluation.score(_qa_records(spark, sf_dir), "qa")
    return scored.select("num_q", "correct", "n_empty", _rounded("ratio"))


EVALUATION_QA_SCORE = """
WITH answers AS (
  SELECT p_partkey % 11 = 0 AS missing, p_partkey % 7 = 0 AS empty, p_partkey % 5 = 0 AS wrong FROM part)
SELECT count(*) AS num_q, count(*) FILTER (WHERE NOT missing AND (empty OR NOT wrong)) AS correct,
       count(*) FILTER (WHERE NOT missing AND empty) AS n_empty,
       round(avg((NOT missing AND (empty OR NOT wrong))::INTEGER), 6) AS ratio
FROM answers
"""


def text_metrics_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text metrics of a result file of open questions, whose gold text may be a list."""
    folder = shared_folder(spark, "qa_results", sf_dir)
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        key.alias("seq"),
        "p_name",
        F.lit("").alias("question"),
        F.lit("").alias("pred_solution"),
        F.when(key % 4 < 2, F.col("p_name"))
        .when(key % 4 == 2, F.concat(F.lit("a "), "p_name", F.lit("!")))
        .otherwise(F.lit("none"))
        .alias("pred"),
        F.split("p_name", " ").alias("label"),
    )
    text = rows.filter(key % 3 > 0).withColumnRenamed("p_name", "original_sln")
    listed = rows.filter(key % 3 == 0).withColumn("original_sln", F.split("p_name", " ")).drop("p_name")
    jsonl.write_results(text, folder)
    jsonl.write_results(listed, folder, "append")
    return evaluation.offline_metrics(jsonl.read_results(spark, folder, "qa"), "qa").select(
        "n", _rounded("exact_match"), _rounded("partial_match")
    )


TEXT_METRICS_QA = """
SELECT count(*) AS n,
       round(avg((p_partkey % 3 > 0 AND p_partkey % 4 < 2)::INTEGER), 6) AS exact_match,
       round(avg((p_partkey % 3 > 0 AND p_partkey % 4 < 3)::INTEGER), 6) AS partial_match
FROM part
"""


def running_accuracy_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs apart, one of them without a name."""
    rows = choice_results(spark, sf_dir).join(
        table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("seq"),
            F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("run"),
        ),
        "seq",
    )
    return metrics.running_accuracy(rows, ["run"]).select(
        F.coalesce("run", F.lit("-")).alias("run"),
        "subject", "num_q_so_far", "correct_so_far", _rounded("acc_so_far"),
    )


RUNNING_ACCURACY_BY_RUN = """
WITH results AS (
  SELECT o_orderkey AS seq, 'Q' || o_custkey AS question, o_orderpriority AS subject,
         CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus ELSE '-' END AS run,
         o_orderkey % 3 = o_orderkey % 4 AS hit
  FROM orders),
first AS (
  SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY run, question ORDER BY seq) = 1),
subjects AS (
  SELECT run, subject, count(*) AS n, count(*) FILTER (WHERE hit) AS c FROM first GROUP BY ALL),
running AS (
  SELECT run, subject,
         (sum(n) OVER (PARTITION BY run ORDER BY subject))::BIGINT AS num_q_so_far,
         (sum(c) OVER (PARTITION BY run ORDER BY subject))::BIGINT AS correct_so_far
  FROM subjects)
SELECT *, round(correct_so_far / num_q_so_far, 6) AS acc_so_far FROM running
"""


QUERIES = {
    "math_accuracy": math_accuracy,
    "math_accuracy_by_run": math_accuracy_by_run,
    "choice_accuracy": choice_accuracy,
    "first_questions": first_questions,
    "qa_accuracy": qa_accuracy,
    "qa_accuracy_text_labels": qa_accuracy_text_labels,
    "numeric_metrics": numeric_metrics,
    "text_metrics": text_metrics,
    "subject_accuracy": subject_accuracy,
    "running_accuracy": running_accuracy,
    "average_running_accuracy": average_running_accuracy,
    "macro_micro_accuracy": macro_micro_accuracy,
    "evaluation_math": evaluation_math,
    "evaluation_score": evaluation_score,
    "evaluation_choice": evaluation_choice,
    "evaluation_qa": evaluation_qa,
    "evaluation_qa_score": evaluation_qa_score,
    "text_metrics_qa": text_metrics_qa,
    "running_accuracy_by_run": running_accuracy_by_run,
}

ORACLES = {
    "math_accuracy": MATH_ACCURACY,
    "math_accuracy_by_run": MATH_ACCURACY_BY_RUN,
    "choice_accuracy": CHOICE_ACCURACY,
    "first_questions": FIRST_QUESTIONS,
    "qa_accuracy": QA_ACCURACY,
    "qa_accuracy_text_labels": QA_ACCURACY_TEXT_LABELS,
    "numeric_metrics": NUMERIC_METRICS,
    "text_metrics": TEXT_METRICS,
    "subject_accuracy": SUBJECT_ACCURACY,
    "running_accuracy": RUNNING_ACCURACY,
    "average_running_accuracy": AVERAGE_RUNNING_ACCURACY,
    "macro_micro_accuracy": MACRO_MICRO_ACCURACY,
    "evaluation_math": EVALUATION_MATH,
    "evaluation_score": EVALUATION_SCORE,
    "evaluation_choice": EVALUATION_CHOICE,
    "evaluation_qa": EVALUATION_QA,
    "evaluation_qa_score": EVALUATION_QA_SCORE,
    "text_metrics_qa": TEXT_METRICS_QA,
    "running_accuracy_by_run": RUNNING_ACCURACY_BY_RUN,
}
