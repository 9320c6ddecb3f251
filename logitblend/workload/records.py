"""Result folders that are damaged, retried, growing, or written by several workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logitblend.operators import gather, metrics
from logitblend.plans import evaluation, growing
from logitblend.schemas import MATH_ITEM, RESULTS
from logitblend.sources import jsonl
from logitblend.sources.shared import shared_folder
from logitblend.workload import scoring
from logitblend.workload.inputs import table

PARTS = 8


def _rounded(column: str) -> Column:
    return F.round(column, 6).alias(column)


def _damaged(spark: SparkSession, sf_dir: str, purpose: str) -> str:
    """A folder of math records, some of them cut, one kind with a text for a number, and empty
    lines.  Part and line of a record follow from its number."""
    folder = shared_folder(spark, purpose, sf_dir)
    key = F.col("o_orderkey")
    record = F.to_json(
        F.struct(
            key.alias("seq"),
            F.lit("q").alias("question"),
            F.concat(F.lit("W"), "o_custkey").alias("original_sln"),
            F.lit("").alias("pred_solution"),
            (key % 3).cast("double").alias("pred"),
            F.lit(1.0).alias("label"),
        )
    )
    line = (
        F.when(key % 13 == 0, F.substring(record, F.lit(1), F.length(record) - key % 7 - 1))
        .when(key % 17 == 0, F.replace(record, F.lit('"label":1.0'), F.lit('"label":"one"')))
        .when(key % 19 == 0, F.lit(""))
        .otherwise(record)
    )
    rows = table(spark, sf_dir, "orders").select(
        (key % PARTS).cast("int").alias("part"), "o_orderkey", line.alias("value")
    )
    lines = rows.repartition("part").sortWithinPartitions("part", "o_orderkey").drop("o_orderkey")
    lines.write.mode("overwrite").partitionBy("part").text(folder)
    return folder


SQL_DAMAGED = f"""
WITH records AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % {PARTS} AS part,
         '{{"seq":' || o_orderkey || ',"question":"q","original_sln":"W' || o_custkey
         || '","pred_solution":"","pred":' || o_orderkey % 3 || '.0,"label":1.0}}' AS record
  FROM orders),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY k) AS line,
         CASE WHEN k % 13 = 0 THEN 'json' WHEN k % 17 = 0 THEN 'type' WHEN k % 19 = 0 THEN 'empty'
              ELSE 'none' END AS fault
  FROM records)
"""


def results_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over the lines that are records."""
    folder = _damaged(spark, sf_dir, "cut")
    back = jsonl.read_results(spark, folder, "math", bad="quarantine")
    return evaluation.score(back, "math").select("num_q", "correct", _rounded("ratio"))


RESULTS_QUARANTINED = SQL_DAMAGED + f""",
first AS (
  SELECT *, k % 3 = 1 AS hit FROM lines WHERE fault = 'none'
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY k) = 1)
SELECT {scoring.SQL_ACCURACY} FROM first
"""


def results_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other lines, with their places in their files."""
    folder = _damaged(spark, sf_dir, "cut_lines")
    bad = jsonl.bad_lines(spark, folder, RESULTS["math"])
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("int")
    return bad.select(part.alias("part"), "line", "text", "fault")


RESULTS_BAD_LINES = SQL_DAMAGED + """
SELECT part::INTEGER AS part, line, fault,
       CASE fault WHEN 'json' THEN substring(record, 1, length(record) - k % 7 - 1)
                  ELSE replace(record, '"label":1.0', '"label":"one"') END AS text
FROM lines WHERE fault IN ('json', 'type')
"""


def results_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder to which one call was made twice, and another one died before it was done."""
    folder = shared_folder(spark, "retried", sf_dir)
    rows = scoring.choice_results(spark, sf_dir).withColumn("original_sln", F.col("label"))
    half = F.col("seq") % 2 == 0
    jsonl.write_results(rows.filter(half), folder, "overwrite", call="even")
    # What a call leaves behind that died while it moved its files.
    rows.withColumn("pred", F.col("label")).withColumn("batch", F.lit(1)).write.mode("append").json(folder)
    for _ in range(2):
        jsonl.write_results(rows.filter(~half), folder, "append", call="odd")
    back = jsonl.read_results(spark, folder, "choice")
    return back.groupBy("subject").agg(F.count(F.lit(1)).alias("records")).join(
        metrics.subject_accuracy(back).select("subject", "num_q", "correct"), "subject"
    )


RESULTS_RETRIED = """
WITH results AS (
  SELECT o_custkey AS c, o_orderpriority AS subject, o_orderkey % 3 = o_orderkey % 4 AS hit,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS place
  FROM orders),
records AS (SELECT subject, count(*) AS records FROM results GROUP BY subject)
SELECT subject, records, count(*) AS num_q, count(*) FILTER (WHERE hit) AS correct
FROM results JOIN records USING (subject) WHERE place = 1 GROUP BY subject, records
"""

APPENDS = 3


def growing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running accuracy after each of three appends, of which each is read once."""
    folder, state = (shared_folder(spark, p, sf_dir) for p in ("grown", "grown_state"))
    rows = scoring.choice_results(spark, sf_dir).withColumn("original_sln", F.col("label"))
    steps = []
    for k in range(APPENDS):
        mode = "append" if k else "overwrite"
        jsonl.write_results(rows.filter(F.col("seq") % APPENDS == k), folder, mode, call=f"append {k}")
        growing.absorb(spark, folder, state)
        steps.append(growing.running_accuracy(spark, state).withColumn("appends", F.lit(k + 1)))
    found = steps[0]
    for step in steps[1:]:
        found = found.unionByName(step)
    return found.select(
        "appends", "subject", "num_q_so_far", "correct_so_far", _rounded("acc_so_far")
    )


GROWING_ACCURACY = f"""
WITH results AS (
  SELECT o_custkey AS c, o_orderpriority AS subject, o_orderkey % 3 = o_orderkey % 4 AS hit,
         o_orderkey % {APPENDS} AS k, o_orderkey AS seq
  FROM orders),
appends AS (SELECT unnest(range(1, {APPENDS + 1}))::INTEGER AS appends),
first AS (
  SELECT * FROM results JOIN appends ON k < appends
  QUALIFY row_number() OVER (PARTITION BY appends, c ORDER BY k, seq) = 1),
subjects AS (
  SELECT appends, subject, count(*) AS n, count(*) FILTER (WHERE hit) AS c
  FROM first GROUP BY appends, subject),
running AS (
  SELECT appends, subject,
         (sum(n) OVER (PARTITION BY appends ORDER BY subject))::BIGINT AS num_q_so_far,
         (sum(c) OVER (PARTITION BY appends ORDER BY subject))::BIGINT AS correct_so_far
  FROM subjects)
SELECT *, round(correct_so_far / num_q_so_far, 6) AS acc_so_far FROM running
"""


def levels_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by run and subject, by run, and over all, in one pass."""
    rows = scoring.choice_results(spark, sf_dir).withColumn(
        "run", F.concat(F.lit("run"), F.col("seq") % 5)
    )
    return metrics.levels_accuracy(rows, [("run", "subject"), ("run",), ()]).select(
        "level", F.coalesce("run", F.lit("-")).alias("run"),
        F.coalesce("subject", F.lit("-")).alias("subject"), "num_q", "correct", _rounded("ratio"),
    )


LEVELS_ACCURACY = f"""
WITH results AS (
  SELECT o_orderkey AS seq, o_custkey AS c, o_orderpriority AS subject, 'run' || o_orderkey % 5 AS run,
         o_orderkey % 3 = o_orderkey % 4 AS hit
  FROM orders),
levels AS (
  SELECT 'run,subject' AS level, run, subject, c, hit, seq FROM results
  UNION ALL SELECT 'run', run, '-', c, hit, seq FROM results
  UNION ALL SELECT '', '-', '-', c, hit, seq FROM results),
first AS (
  SELECT * FROM levels
  QUALIFY row_number() OVER (PARTITION BY level, run, subject, c ORDER BY seq) = 1)
SELECT level, run, subject, {scoring.SQL_ACCURACY} FROM first GROUP BY level, run, subject
"""


def levels_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric metrics by flag and status, by flag, by status, and over all, in one pass."""
    off = (F.col("l_linenumber") % 3 - 1) * F.lit(0.5)
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").alias("label"), (F.col("l_quantity") + off).alias("pred")
    )
    sets = [("l_returnflag", "l_linestatus"), ("l_returnflag",), ("l_linestatus",), ()]
    return metrics.levels_metrics(rows, sets, metrics.numeric_metrics).select(
        "level", F.coalesce("l_returnflag", F.lit("-")).alias("l_returnflag"),
        F.coalesce("l_linestatus", F.lit("-")).alias("l_linestatus"), "n",
        *[_rounded(c) for c in ("accuracy", "mae", "exact_match")],
    )


LEVELS_NUMERIC = """
WITH results AS (
  SELECT l_returnflag, l_linestatus, l_quantity AS label,
         l_quantity + (l_linenumber % 3 - 1) * 0.5::DOUBLE AS pred
  FROM lineitem)
SELECT concat_ws(',', CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' END,
                 CASE WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' END) AS level,
       coalesce(l_returnflag, '-') AS l_returnflag, coalesce(l_linestatus, '-') AS l_linestatus,
       count(*) AS n, round(avg((round_even(pred, 0) = label)::INTEGER), 6) AS accuracy,
       round(avg(abs(label - pred)), 6) AS mae, round(avg((pred = label)::INTEGER), 6) AS exact_match
FROM results GROUP BY CUBE (l_returnflag, l_linestatus)
"""


def zipped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and predictions logged in two folders of unequal length, side by side."""
    asked, told = (shared_folder(spark, p, sf_dir) for p in ("asked", "told"))
    table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("Question "), "o_orderkey").alias("question"), F.lit("#### 1").alias("answer")
    ).orderBy("o_orderkey").drop("o_orderkey").write.mode("overwrite").json(asked)
    table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("answer of "), "c_custkey").alias("pred")
    ).orderBy(F.desc("c_custkey")).drop("c_custkey").write.mode("overwrite").json(told)
    questions = jsonl.read_items(spark, asked, MATH_ITEM).select("question", "seq")
    return gather.zipped([questions, jsonl.read_items(spark, told, "pred string")])


ZIPPED_COLUMNS = """
WITH asked AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, 'Question ' || o_orderkey AS question FROM orders),
told AS (
  SELECT row_number() OVER (ORDER BY c_custkey DESC) - 1 AS place, 'answer of ' || c_custkey AS pred FROM customer)
SELECT place, question, pred FROM asked JOIN told USING (place)
"""

WORKERS, BATCH = 3, 4


def gathered_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions dealt to three workers in batches of four, the last ones filled up with the
    first questions, logged in a folder for each worker; the results in order again."""
    folder = shared_folder(spark, "workers", sf_dir)
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("question"))
    total = items.count()
    rounds = -(-total // (WORKERS * BATCH))
    # Part keys count from 0; the filled-up list begins anew behind the last one.
    index = F.col("k")
    again = items.filter(index < rounds * WORKERS * BATCH - total).withColumn("k", F.col("k") + total)
    dealt = items.unionAll(again).select(
        F.expr(f"k div {BATCH} % {WORKERS}").alias("worker"),
        "k",
        F.concat("question", F.lit(" "), F.col("k") % total).alias("question"),
    )
    logged = dealt.repartitionByRange(8, "worker", "k").sortWithinPartitions("worker", "k")
    logged.drop("k").write.mode("overwrite").partitionBy("worker").json(folder)
    back = jsonl.read_items(spark, folder, "question string")
    return gather.gathered(back, "worker", WORKERS, BATCH).select("seq", "question", "worker")


GATHERED_WORKERS = f"""
SELECT p_partkey AS seq, p_name || ' ' || p_partkey % count(*) OVER () AS question,
       ((p_partkey // {BATCH}) % {WORKERS})::INTEGER AS worker
FROM part
"""

QUERIES = {
    "results_quarantined": results_quarantined,
    "results_bad_lines": results_bad_lines,
    "results_retried": results_retried,
    "growing_accuracy": growing_accuracy,
    "levels_accuracy": levels_accuracy,
    "levels_numeric": levels_numeric,
    "zipped_columns": zipped_columns,
    "gathered_workers": gathered_workers,
}

ORACLES = {
    "results_quarantined": RESULTS_QUARANTINED,
    "results_bad_lines": RESULTS_BAD_LINES,
    "results_retried": RESULTS_RETRIED,
    "growing_accuracy": GROWING_ACCURACY,
    "levels_accuracy": LEVELS_ACCURACY,
    "levels_numeric": LEVELS_NUMERIC,
    "zipped_columns": ZIPPED_COLUMNS,
    "gathered_workers": GATHERED_WORKERS,
}
