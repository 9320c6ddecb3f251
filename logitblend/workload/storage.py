"""Paths as columns, and result files written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logitblend.operators import dedup, metrics
from logitblend.plans import ensemble, evaluation, subjects
from logitblend.schemas import MATH_ITEM
from logitblend.sources import jsonl, runs
from logitblend.sources import logits as logit_tables
from logitblend.sources.shared import shared_folder
from logitblend.workload import blending, inputs, prompting, scoring
from logitblend.workload.inputs import table

# Folders a page is filed under, by page number.
FOLDERS = ("GSM", "TriviaQA", "NaturalQuestions", "nq", "ARC", "PIQA", "PIQA-arc", "misc")
MODELS = ("Llama-2-7b-chat-hf", "deepseek-llm-7b-chat", "models/Qwen-fish-hf/", "half")


def _nth(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _sql_nth(values: tuple[str, ...], n: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[{n} % {len(values)} + 1]"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.col("url"), F.lit("/"), _nth(FOLDERS, page), F.lit("/test.jsonl")).alias("path"),
        F.concat(F.lit("/m/"), _nth(MODELS, page)).alias("model_1"),
        F.concat(F.lit("/n/"), _nth(MODELS, page + 1)).alias("model_2"),
    )


SQL_PATHS = f"""
WITH paths AS (
  SELECT page_id, url || '/' || {_sql_nth(FOLDERS, "page_id")} || '/test.jsonl' AS path,
         '/m/' || {_sql_nth(MODELS, "page_id")} AS model_1,
         '/n/' || {_sql_nth(MODELS, "(page_id + 1)")} AS model_2
  FROM pages)
"""


def task_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")

    def scorers(baseline: bool) -> Column:
        return F.array_join(runs.scorers_of(path, baseline), "+")

    return _paths(spark, sf_dir).select(
        "page_id", "path",
        F.coalesce(runs.task_of(path), F.lit("none")).alias("task"),
        F.coalesce(runs.task_of(path, baseline=True), F.lit("none")).alias("baseline_task"),
        scorers(False).alias("scorers"),
        scorers(True).alias("baseline_scorers"),
    )


TASK_ROUTING = SQL_PATHS + """,
marks AS (
  SELECT *, contains(lower(path), 'gsm') AS m,
         contains(lower(path), 'triviaqa') OR contains(lower(path), 'nq') AS q,
         contains(lower(path), 'triviaqa') OR contains(lower(path), 'naturalquestions') AS b,
         contains(lower(path), 'arc') AS a, contains(lower(path), 'piqa') AS p
  FROM paths)
SELECT page_id, path,
       CASE WHEN p THEN 'choice2' WHEN a THEN 'choice4' WHEN q THEN 'qa' WHEN m THEN 'math'
            ELSE 'none' END AS task,
       CASE WHEN p THEN 'choice2' WHEN a THEN 'choice4' WHEN b THEN 'qa' WHEN m THEN 'math'
            ELSE 'none' END AS baseline_task,
       concat_ws('+', CASE WHEN m THEN 'math' END, CASE WHEN q THEN 'qa' END,
                 CASE WHEN a OR p THEN 'choice' END) AS scorers,
       concat_ws('+', CASE WHEN m THEN 'math' END, CASE WHEN b THEN 'qa' END,
                 CASE WHEN a OR p THEN 'choice' END) AS baseline_scorers
FROM marks
"""


def run_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select(
        "page_id",
        runs.ensemble_run_name(F.col("model_1"), F.col("model_2"), F.col("path")).alias("ensemble"),
        runs.baseline_run_name(F.col("model_1"), F.col("path")).alias("baseline"),
    )


RUN_NAMING = SQL_PATHS + r"""
SELECT page_id,
       regexp_replace(list_last(string_split(rtrim(model_1, '/'), '/')), '[-hf]+$', '') || '_'
       || regexp_replace(list_last(string_split(rtrim(model_2, '/'), '/')), '[-hf]+$', '') || '_'
       || string_split(path, '/')[-2] || '.jsonl' AS ensemble,
       string_split(path, '/')[-2] || '_' || string_split(model_1, '/')[-1] || '.jsonl' AS baseline
FROM paths
"""


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as JSON Lines and read back, NaN and text included."""
    folder = shared_folder(spark, "labels", sf_dir)
    toxic = F.col("toxic").cast("double")
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("文档 "), "doc_id", F.lit("\n\"é\"")).alias("question"),
        F.col("quality").cast("string").alias("original_sln"),
        F.lit("").alias("pred_solution"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(scoring.NAN)).otherwise(toxic).alias("pred"),
        F.col("quality").cast("double").alias("label"),
    )
    jsonl.write_results(rows, folder)
    return jsonl.read_results(spark, folder, "math", numbered=False).select(
        "seq", "question", "original_sln", "pred_solution",
        F.isnan("pred").alias("pred_is_nan"),
        F.nanvl("pred", F.lit(-1.0)).alias("pred"),
        "label",
    )


JSONL_ROUND_TRIP = """
SELECT doc_id AS seq, '文档 ' || doc_id || chr(10) || '"é"' AS question,
       quality::VARCHAR AS original_sln, '' AS pred_solution, doc_id % 5 = 0 AS pred_is_nan,
       CASE WHEN doc_id % 5 = 0 THEN -1.0 ELSE toxic END::DOUBLE AS pred,
       quality::DOUBLE AS label
FROM labels
"""


def results_file_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records, then those of two later runs appended, with other answers and lower or
    equal numbers, read back and scored: the first run's record of a question counts."""
    folder = shared_folder(spark, "results", sf_dir)
    rows = scoring.choice_results(spark, sf_dir).withColumn("original_sln", F.col("label"))
    again = rows.withColumn("pred", F.col("label"))
    jsonl.write_results(rows, folder, "overwrite")
    jsonl.write_results(again.withColumn("seq", F.col("seq") - 7), folder, "append")
    jsonl.write_results(again, folder, "append")
    back = jsonl.read_results(spark, folder, "choice")
    return metrics.subject_accuracy(back).select(
        "subject", "num_q", "correct", F.round("ratio", 6).alias("ratio")
    )


def results_without_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the format of files written elsewhere, without numbers: of a repeated
    question, the record that lies first in the files counts."""
    folder = shared_folder(spark, "unnumbered", sf_dir)
    rows = scoring.math_results(spark, sf_dir).select(
        "seq",
        F.lit("").alias("question"),
        "original_sln",
        F.lit("").alias("pred_solution"),
        "pred",
        "label",
    )
    rows.orderBy("seq").drop("seq").write.mode("overwrite").json(folder)
    back = jsonl.read_results(spark, folder, "math")
    return evaluation.score(back, "math").select(
        "num_q", "correct", F.round("ratio", 6).alias("ratio")
    )


def question_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question set written in falling order of its keys; of a repeated question, the
    item that comes first in the files."""
    folder = shared_folder(spark, "questions", sf_dir)
    items = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Question of customer "), "o_custkey").alias("question"),
        F.concat(F.lit("#### "), "o_orderkey").alias("answer"),
    )
    items.orderBy(F.desc("o_orderkey")).drop("o_orderkey").write.mode("overwrite").json(folder)
    back = jsonl.read_items(spark, folder, MATH_ITEM)
    return dedup.first_rows(back, ["question"]).select("question", "answer")


QUESTION_FILE_ORDER = """
SELECT 'Question of customer ' || o_custkey AS question, '#### ' || max(o_orderkey) AS answer
FROM orders GROUP BY o_custkey
"""


def prompt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt file, written from a table, in front of the questions of another."""
    folder = shared_folder(spark, "prompt", sf_dir)
    names = F.array_join(F.array_sort(F.collect_list("r_name")), ", ")
    text = F.concat(F.lit("Question: which regions are there?\nAnswer: "), names)
    regions = table(spark, sf_dir, "region").agg(text.alias("value"))
    regions.coalesce(1).write.mode("overwrite").text(folder)
    prompt = jsonl.read_prompt(spark, folder).rstrip("\n")
    items = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    return evaluation.render(items, "qa", prompt).select("conv_id", "turn", "prompt")


PROMPT_FILE = """
WITH prompt AS (
  SELECT 'Question: which regions are there?' || chr(10) || 'Answer: '
         || string_agg(r_name, ', ' ORDER BY r_name) AS prompt
  FROM region)
SELECT conv_id, turn, prompt || chr(10) || chr(10) || 'Question: ' || text || chr(10)
       || 'Answer:' AS prompt
FROM conversations, prompt
"""


def subject_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and worked examples in one file per subject, read back as a benchmark."""
    folders = []
    for name, items in {
        "test": prompting._customer_items(spark, sf_dir),
        "shots": prompting._nation_shots(spark, sf_dir),
    }.items():
        folders.append(shared_folder(spark, name, sf_dir))
        jsonl.write_subjects(items, folders[-1], "seq")
    return subjects.prompts(spark, *folders).select("subject", "prompt")


def ensemble_pick_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-model blend over a logits table bucketed by step."""
    folder = shared_folder(spark, "logits", sf_dir)
    name = f"logits_{folder.rsplit('-', 1)[-1]}"  # written over by the next call
    logit_tables.write_bucketed(inputs.logits(spark, sf_dir, 2), name, 8, folder)
    picked = ensemble.picks(
        logit_tables.read_bucketed(spark, name),
        inputs.vocab(spark, 2),
        inputs.subtokens(spark, 2),
        inputs.profiles(2),
        colocated=True,
    )
    return blending.report_picks(picked, 2)


QUERIES = {
    "task_routing": task_routing,
    "run_naming": run_naming,
    "jsonl_round_trip": jsonl_round_trip,
    "results_file_accuracy": results_file_accuracy,
    "results_without_seq": results_without_seq,
    "question_file_order": question_file_order,
    "prompt_file": prompt_file,
    "subject_folder": subject_folder,
    "ensemble_pick_bucketed": ensemble_pick_bucketed,
}

ORACLES = {
    "task_routing": TASK_ROUTING,
    "run_naming": RUN_NAMING,
    "jsonl_round_trip": JSONL_ROUND_TRIP,
    "results_file_accuracy": scoring.SUBJECT_ACCURACY,
    "results_without_seq": scoring.MATH_ACCURACY,
    "question_file_order": QUESTION_FILE_ORDER,
    "prompt_file": PROMPT_FILE,
    "subject_folder": f"SELECT subject, prompt FROM ({prompting.PROMPT_FEW_SHOT})",
    "ensemble_pick_bucketed": blending.ORACLES["ensemble_pick_2"],
}
