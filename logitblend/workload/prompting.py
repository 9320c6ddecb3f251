"""Prompt rendering over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logitblend.operators import fewshot
from logitblend.plans import evaluation
from logitblend.workload.inputs import table

PROMPT = "Question: how many legs has a cat?\nAnswer: 4"


def prompt_two_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("What is a "), "p_name", F.lit("?")).alias("question"),
        F.col("p_brand").alias("A"),
        F.col("p_type").alias("B"),
    )
    return evaluation.render(items, "choice2").select("p_partkey", "prompt")


PROMPT_TWO_CHOICE = """
SELECT p_partkey, 'Answer the question by replying A or B.' || chr(10)
       || 'Question: What is a ' || p_name || '?' || chr(10) || 'A: ' || p_brand || chr(10)
       || 'B: ' || p_type || chr(10) || 'Answer:' AS prompt
FROM part
"""


def _customer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One four-choice item per customer; its subject is the customer's region."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("seq"),
            F.col("r_name").alias("subject"),
            F.concat(F.lit("Which is the segment of "), "c_name", F.lit("?")).alias("question"),
            F.col("c_mktsegment").alias("A"),
            F.col("n_name").alias("B"),
            F.concat(F.lit("none, "), "r_name").alias("C"),
            F.col("c_custkey").cast("string").alias("D"),
            F.char(F.lit(65) + F.col("c_custkey") % 4).alias("answer"),
        )
    )


def _nation_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One worked example per nation; its subject is the nation's region.  The
    last region has none, and one subject has no customers."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    last = F.col("r_name") == "MIDDLE EAST"
    return nation.select(
        F.col("n_nationkey").alias("seq"),
        F.when(last, F.concat(F.lit("not "), "r_name")).otherwise(F.col("r_name")).alias("subject"),
        F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"),
        F.col("r_name").alias("A"),
        F.lit("At sea").alias("B"),
        F.col("n_name").alias("C"),
        F.lit("Nowhere").alias("D"),
        F.lit("A").alias("answer"),
    )


def prompt_four_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _customer_items(spark, sf_dir)
    return evaluation.render(items, "choice4").select("seq", "subject", "prompt")


SQL_ITEMS = """
WITH items AS (
  SELECT c_custkey AS seq, r_name AS subject,
         'Answer the question by replying A, B, C or D.' || chr(10)
         || 'Question: Which is the segment of ' || c_name || '?' || chr(10)
         || 'A: ' || c_mktsegment || chr(10) || 'B: ' || n_name || chr(10)
         || 'C: none, ' || r_name || chr(10) || 'D: ' || c_custkey || chr(10) || 'Answer:' AS prompt
  FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)
"""
PROMPT_FOUR_CHOICE = SQL_ITEMS + "SELECT seq, subject, prompt FROM items"


def prompt_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fewshot.few_shot_prompts(
        _customer_items(spark, sf_dir), _nation_shots(spark, sf_dir)
    ).select("seq", "subject", "prompt")


PROMPT_FEW_SHOT = SQL_ITEMS + """,
shots AS (
  SELECT n_nationkey AS seq,
         CASE WHEN r_name = 'MIDDLE EAST' THEN 'not ' || r_name ELSE r_name END AS subject,
         'Question: Where is ' || n_name || '?' || chr(10) || 'A: ' || r_name || chr(10)
         || 'B: At sea' || chr(10) || 'C: ' || n_name || chr(10) || 'D: Nowhere' || chr(10)
         || 'Answer: A' || chr(10) || chr(10) AS example
  FROM nation JOIN region ON n_regionkey = r_regionkey),
blocks AS (SELECT subject, string_agg(example, '' ORDER BY seq) AS block FROM shots GROUP BY subject)
SELECT seq, subject, block || prompt AS prompt FROM items JOIN blocks USING (subject)
"""


def prompt_open_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    return evaluation.render(items, "qa", PROMPT).select("conv_id", "turn", "prompt")


SQL_PROMPT = "'Question: how many legs has a cat?' || chr(10) || 'Answer: 4'"
PROMPT_OPEN_QA = f"""
SELECT conv_id, turn, {SQL_PROMPT} || chr(10) || chr(10) || 'Question: ' || text
       || chr(10) || 'Answer:' AS prompt
FROM conversations
"""


def prompt_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(
            F.lit("Customer "), "o_custkey", F.lit(" places order "), "o_orderkey",
            F.lit(". How many?"),
        ).alias("question"),
    )
    plain = evaluation.render(items, "math", PROMPT)
    doubled = evaluation.render(
        plain.withColumnRenamed("prompt", "plain"), "math", PROMPT, style="doubled"
    )
    return doubled.select("o_orderkey", "plain", F.col("prompt").alias("doubled"))


PROMPT_MATH = f"""
WITH asked AS (
  SELECT o_orderkey, 'Question: Customer ' || o_custkey || ' places order ' || o_orderkey
         || '. How many?' || chr(10) || 'Let''s think step by step' || chr(10) AS tail
  FROM orders)
SELECT o_orderkey, {SQL_PROMPT} || chr(10) || chr(10) || tail AS plain,
       {SQL_PROMPT} || {SQL_PROMPT} || chr(10) || '请逐步思考，并通过' || chr(8) || 'oxed{{}}给出最终数值答案'
       || chr(10) || chr(10) || tail AS doubled
FROM asked
"""


def gold_format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.col("o_orderkey") % 4
    key = F.col("o_custkey").cast("string")
    answer = (
        F.when(style == 0, F.concat(F.lit("The ANSWER is -"), key))
        .when(style == 1, F.concat(F.lit("#### "), key))
        .when(style == 2, F.concat(F.lit("answer is "), F.col("o_orderpriority")))
        .otherwise(F.concat(F.lit("answer is "), F.col("o_orderstatus")))
    )
    items = table(spark, sf_dir, "orders").select("o_orderkey", answer.alias("answer"))
    return fewshot.odd_gold_answers(items)


GOLD_FORMAT_CHECK = r"""
WITH items AS (
  SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN 'The ANSWER is -' || o_custkey
    WHEN 1 THEN '#### ' || o_custkey
    WHEN 2 THEN 'answer is ' || o_orderpriority
    ELSE 'answer is ' || o_orderstatus END AS answer
  FROM orders)
SELECT * FROM items WHERE NOT regexp_matches(answer, '(?i)answer is (-?\d+)')
"""


QUERIES = {
    "prompt_two_choice": prompt_two_choice,
    "prompt_four_choice": prompt_four_choice,
    "prompt_few_shot": prompt_few_shot,
    "prompt_open_qa": prompt_open_qa,
    "prompt_math": prompt_math,
    "gold_format_check": gold_format_check,
}

ORACLES = {
    "prompt_two_choice": PROMPT_TWO_CHOICE,
    "prompt_four_choice": PROMPT_FOUR_CHOICE,
    "prompt_few_shot": PROMPT_FEW_SHOT,
    "prompt_open_qa": PROMPT_OPEN_QA,
    "prompt_math": PROMPT_MATH,
    "gold_format_check": GOLD_FORMAT_CHECK,
}
