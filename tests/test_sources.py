"""Files, folders, run names."""

import json
import math

import pytest
from pyspark.sql import functions as F

from logitblend.operators import dedup, fewshot, metrics
from logitblend.plans import evaluation, subjects
from logitblend.schemas import CHOICE4_ITEM, MATH_ITEM, QA_ITEM
from logitblend.sources import jsonl, runs, shared

ITEM = {"question": "q", "A": "1", "B": "2", "C": "3", "D": "4", "answer": "A", "domain": "d"}


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records), "utf-8")


def test_items_keep_file_order(spark, tmp_path):
    for f in range(3):
        write(tmp_path / f"f{f}.jsonl",
              [{"question": f"{f}-{i:03d}", "answer": "#### 1"} for i in range(200)])
    rows = jsonl.read_items(spark, str(tmp_path), MATH_ITEM)
    got = [r["question"] for r in rows.orderBy("seq").collect()]
    assert got == sorted(got) and len(got) == 600
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # many splits per file
    try:
        split = jsonl.read_items(spark, str(tmp_path), MATH_ITEM)
        assert split.rdd.getNumPartitions() > 3
        assert [r["question"] for r in split.orderBy("seq").collect()] == got
        repeated = split.withColumn("question", F.substring("question", 1, 1))
        first = dedup.first_rows(repeated, ["question"], "seq")
        assert first.count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_subject_folders(spark, tmp_path):
    write(tmp_path / "test" / "high school art.jsonl", [{**ITEM, "question": f"t{i}"} for i in range(3)])
    write(tmp_path / "test" / "only_test.jsonl", [ITEM])
    write(tmp_path / "dev" / "high school art.jsonl",
          [{**ITEM, "question": f"s{i}", "answer": "B"} for i in range(5)])
    write(tmp_path / "dev" / "only_dev.jsonl", [ITEM])
    rows = subjects.prompts(spark, str(tmp_path / "test"), str(tmp_path / "dev")).collect()
    assert {r["subject"] for r in rows} == {"high school art"} and len(rows) == 3
    block = "".join(f"Question: s{i}\nA: 1\nB: 2\nC: 3\nD: 4\nAnswer: B\n\n" for i in range(5))
    asked = "Answer the question by replying A, B, C or D.\nQuestion: t0\nA: 1\nB: 2\nC: 3\nD: 4\nAnswer:"
    assert block + asked in {r["prompt"] for r in rows}


def jobs(spark, group, make):
    """Jobs that building a table starts."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        made = make()
        return made, list(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_any_number_of_worked_examples(spark):
    shots = spark.createDataFrame(
        [(i, "s", *"qABCDa") for i in range(12_000)],
        "seq int, subject string, question string, A string, B string, C string, D string, answer string")
    items = shots.limit(1)
    made, started = jobs(spark, "shots", lambda: fewshot.few_shot_prompts(items, shots))
    assert not started
    assert made.first()["prompt"].count("Answer: a\n\n") == 12_000
    count = fewshot.shot_counts(shots).first()
    block = fewshot.few_shot_blocks(shots).first()["few_shot"]
    assert (count["shots"], count["bytes"]) == (12_000, len(block))


def test_prompt_is_one_string(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("one\n\ntwo 文\n", "utf-8")
    assert jsonl.read_prompt(spark, str(path)) == "one\n\ntwo 文\n"
    path.write_text("x" * (17 << 20), "utf-8")
    assert len(jsonl.read_prompt(spark, str(path))) == 17 << 20


def test_records_without_seq_are_scored(spark, tmp_path):
    """The record format of files that were written elsewhere."""
    write(tmp_path / "r" / "out.jsonl", [
        {"question": f"q{i}", "original_sln": f"s{i}", "pred_solution": "", "pred": i, "label": i}
        for i in range(4)] + [
        {"question": "q0", "original_sln": "s0", "pred_solution": "", "pred": 9, "label": 0}])
    rows = jsonl.read_results(spark, str(tmp_path / "r"), "math")
    got = evaluation.score(rows, "math").first()
    assert (got["num_q"], got["correct"]) == (4, 4)


def test_rows_without_order_keep_their_value(spark):
    rows = spark.createDataFrame(
        [(None, "a", 1.0, 1.0), (None, "b", 2.0, 2.0), (5, "b", 2.0, 3.0)],
        "seq bigint, original_sln string, pred double, label double")
    got = metrics.math_accuracy(rows).first()
    assert (got["num_q"], got["correct"]) == (2, 1)  # a row with a place comes first
    assert dedup.first_rows(rows, ["original_sln"]).filter("seq = 5").count() == 1


def test_what_was_appended_later_comes_later(spark, tmp_path):
    schema = ("seq bigint, question string, original_sln string, pred_solution string, "
              "pred double, label double")
    folder = str(tmp_path / "r")
    # The first run's record is wrong and has the higher number; equal numbers, too.
    first = [(7, "q", "s", "", 1.0, 2.0), (3, "q", "t", "", 1.0, 2.0)]
    later = [(3, "q", "s", "", 2.0, 2.0), (3, "q", "t", "", 2.0, 2.0)]
    for rows in (first, later, later):
        jsonl.write_results(spark.createDataFrame(rows, schema), folder, "append")
    got = evaluation.score(jsonl.read_results(spark, folder, "math"), "math").first()
    assert (got["num_q"], got["correct"]) == (2, 0)


def test_subjects_are_files(spark, tmp_path):
    items = spark.createDataFrame(
        [(-i, f"q{i:02d}", *"1234", "A", "d", s)
         for i, s in enumerate(["high art", "a-b", "x.y"] * 30)],
        "nth int, question string, A string, B string, C string, D string, answer string, "
        "domain string, subject string")
    folder = str(tmp_path / "s")
    for _ in range(2):
        jsonl.write_subjects(items, folder, "nth")
    assert len(list((tmp_path / "s").glob("*.jsonl"))) == 3
    back = jsonl.read_subjects(spark, folder, CHOICE4_ITEM)
    assert {(r["subject"], r["count"]) for r in back.groupBy("subject").count().collect()} == {
        ("high art", 30), ("a-b", 30), ("x.y", 30)}
    got = [r["question"] for r in back.filter("subject = 'a-b'").orderBy("seq").collect()]
    assert got == sorted(got, reverse=True)


def test_shared_folder_without_a_setting(monkeypatch):
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master, applicationId = "local[4]", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    one, two = (shared.shared_folder(Session(), "x") for _ in range(2))
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session(), "x")


def test_shared_tables_can_be_cleared(tmp_path):
    class Part:  # a session with a folder of its own
        pass

    from pyspark.sql import SparkSession

    real = SparkSession.getActiveSession()
    session = Part()
    session.conf = Part()
    session.sparkContext = real.sparkContext
    session.conf.get = lambda name, default: str(tmp_path)
    folder = shared.shared_folder(session, "x", "key")
    assert folder == shared.shared_folder(session, "x", "key")
    real.range(3).write.parquet(folder)
    assert list(tmp_path.rglob("*.parquet"))
    shared.clear(session)
    assert not list(tmp_path.iterdir())


def test_text_metrics_of_open_questions(spark, tmp_path):
    write(tmp_path / "r" / "qa.jsonl", [
        {"question": "a", "original_sln": "Prince", "pred_solution": "", "pred": "Prince", "label": "Prince"},
        {"question": "b", "original_sln": "x", "pred_solution": "", "pred": "an x.", "label": ["x"]},
        {"question": "c", "original_sln": ["x", "y"], "pred_solution": "", "pred": "x", "label": ["x"]}])
    rows = jsonl.read_results(spark, str(tmp_path / "r"), "qa")
    got = evaluation.offline_metrics(rows, "qa").first()
    assert (got["n"], round(got["exact_match"], 6), round(got["partial_match"], 6)) == (3, 0.333333, 0.666667)


def test_running_accuracy_of_a_run_without_name(spark):
    rows = spark.createDataFrame(
        [(1, None, "a", "q1", "A", "A"), (2, None, "b", "q2", "B", "A"), (3, None, None, "q3", "A", "A")],
        "seq bigint, run string, subject string, question string, pred string, label string")
    got = {r["subject"]: (r["num_q_so_far"], r["correct_so_far"])
           for r in metrics.running_accuracy(rows, ["run"]).collect()}
    assert got == {None: (1, 1), "a": (2, 2), "b": (3, 2)}


def test_question_answers_of_either_shape(spark, tmp_path):
    write(tmp_path / "qa.jsonl",
          [{"question": "a", "answer": "Prince"}, {"question": "b", "answer": ["x", "Prince"]}])
    rows = jsonl.read_items(spark, str(tmp_path), QA_ITEM).select(
        F.lit("Pri.").alias("pred"), F.col("answer").alias("label"))
    assert metrics.qa_accuracy(rows).first()["correct"] == 2


def test_results_with_nan_literals(spark, tmp_path):
    path = tmp_path / "r" / "out.jsonl"
    path.parent.mkdir()
    path.write_text(
        '{"question": "q", "original_sln": "a", "pred_solution": "", "pred": NaN, "label": NaN}\n'
        '{"question": "q", "original_sln": "a", "pred_solution": "", "pred": 1.0, "label": 1.0}\n'
        '{"question": "q", "original_sln": "b", "pred_solution": "", "pred": 2, "label": 2.0}\n')
    rows = jsonl.read_results(spark, str(path.parent), "math")
    assert math.isnan(rows.orderBy("order").first()["pred"])
    got = metrics.math_accuracy(rows, order="order").first()
    assert (got["num_q"], got["correct"]) == (2, 1)


def test_append_and_partitioned_results(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "q1", "é", "A", "A", "A", "art")],
        "seq bigint, question string, original_sln string, pred_solution string, pred string, "
        "label string, subject string")
    folder = str(tmp_path / "out")
    for mode in ("overwrite", "append", "append"):
        jsonl.write_results(rows, folder, mode)
    assert jsonl.read_results(spark, folder, "choice").count() == 3
    jsonl.write_results(rows, folder, "overwrite", partition_by=("subject",))
    assert (tmp_path / "out" / "subject=art").is_dir()
    assert jsonl.read_results(spark, folder, "choice").first()["subject"] == "art"
    assert "é" in "".join(p.read_text("utf-8") for p in tmp_path.glob("out/*/*.json"))


def test_results_by_dataset(spark, tmp_path):
    items = spark.createDataFrame(
        [(1, "gsm", "p1", "#### 4", "#### 4"), (2, "gsm", "p2", "#### 5", "none"),
         (3, "other", "p1", "#### 4", "4.")],
        "seq bigint, dataset string, prompt string, answer string, output string")
    records = evaluation.records(items, "math", "strict", extra=["seq", "dataset"])
    jsonl.write_results(records, str(tmp_path / "r"), "append", partition_by=("dataset",))
    back = jsonl.read_results(spark, str(tmp_path / "r"), "math")
    got = evaluation.score(back, "math", by=["dataset"]).collect()
    assert {r["dataset"]: (r["num_q"], r["correct"]) for r in got} == {"gsm": (2, 1), "other": (1, 1)}
    plain = jsonl.read_results(spark, str(tmp_path / "r"), "math", numbered=False)
    for part in (
        plain.filter("dataset = 'gsm'"),
        jsonl.read_results(spark, str(tmp_path / "r"), "math", "dataset = 'gsm'"),
    ):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(dataset" in plan
        assert part.count() == 2


@pytest.mark.parametrize(
    "path, task, scorers, baseline",
    [
        ("/d/GSM/test.jsonl", "math", ["math"], "math"),
        ("/d/TriviaQA/x", "qa", ["qa"], "qa"),
        ("/d/nq/x", "qa", ["qa"], None),
        ("/d/NaturalQuestions/x", None, [], "qa"),
        ("/d/PIQA/arc", "choice2", ["choice"], "choice2"),
        ("/gsm/ARC/x", "choice4", ["math", "choice"], "choice4"),
        ("/other", None, [], None),
    ],
)
def test_task_routing(evaluate, path, task, scorers, baseline):
    assert evaluate(lambda: runs.task_of(F.col("p")), p=path) == task
    assert evaluate(lambda: runs.task_of(F.col("p"), baseline=True), p=path) == baseline
    assert evaluate(lambda: runs.scorers_of(F.col("p")), p=path) == scorers


def test_run_names(evaluate):
    got = evaluate(
        lambda: runs.ensemble_run_name(F.col("a"), F.col("b"), F.col("t")),
        a="/m/Llama-2-7b-chat-hf", b="/m/my-fish-hf/", t="/data/GSM/test.jsonl")
    assert got == "Llama-2-7b-chat_my-fis_GSM.jsonl"
    got = evaluate(lambda: runs.baseline_run_name(F.col("m"), F.col("t")),
                   m="/m/Qwen3-0.6B", t="/data/PIQA/dev.jsonl")
    assert got == "PIQA_Qwen3-0.6B.jsonl"


def test_shared_folder_is_the_clusters(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    folder = shared.shared_folder(spark, "x")
    assert folder.startswith(root) and folder != shared.shared_folder(spark, "x")
    table = spark.range(5)
    assert shared.written(table, "ids").count() == 5
