"""Damaged, retried, growing and gathered result folders; metrics at several levels."""

import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logitblend.operators import gather, metrics, sequences
from logitblend.plans import evaluation, growing
from logitblend.schemas import CHOICE4_ITEM, MATH_ITEM, RESULTS
from logitblend.sources import calls, jsonl

RECORD = {"seq": 0, "question": "q", "original_sln": "g", "pred_solution": "", "pred": 1.0, "label": 1.0}
CHOICE = "seq bigint, question string, original_sln string, pred_solution string, pred string, label string, subject string"


def lines(path, values):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(v + "\n" for v in values), "utf-8")


def choices(spark, n, seed, questions=40, subjects=4, start=0):
    r = random.Random(seed)
    rows = [
        (start + i, f"q{r.randrange(questions)}" + "x" * (100 * (i % 2)), "g", "", r.choice("AB"), "A", f"s{r.randrange(subjects)}")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, CHOICE)


def test_a_cut_line_ends_the_query_or_is_shown(spark, tmp_path):
    good = [json.dumps(RECORD | {"seq": i, "original_sln": f"g{i}"}) for i in range(4)]
    cut, typed = good[1][: len(good[1]) // 2], good[2].replace('"pred": 1.0', '"pred": "one"')
    nan = good[3].replace('"pred": 1.0', '"pred": NaN')
    lines(tmp_path / "r" / "a.jsonl", [good[0], "", cut, nan])
    lines(tmp_path / "r" / "b.jsonl", [typed, good[1], "  "])
    folder = str(tmp_path / "r")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        evaluation.score(jsonl.read_results(spark, folder, "math"), "math").collect()
    kept = jsonl.read_results(spark, folder, "math", bad="quarantine")
    assert tuple(evaluation.score(kept, "math").first()) == (3, 2, pytest.approx(2 / 3))
    assert not [c for c in kept.columns if c.startswith("_")]
    bad = jsonl.bad_lines(spark, folder, RESULTS["math"]).orderBy("file", "line").collect()
    assert [(r.file.rsplit("/", 1)[-1], r.line, r.text, r.fault) for r in bad] == [
        ("a.jsonl", 3, cut, "json"),
        ("b.jsonl", 1, typed, "type"),
    ]
    with pytest.raises(ValueError, match="quarantine"):
        jsonl.read_results(spark, folder, "math", bad="ignore")


def test_bad_lines_have_their_number_in_files_of_many_splits(spark, tmp_path):
    rows = [json.dumps({"question": f"q{i}", "answer": "a" * 50}) for i in range(900)]
    for i in (0, 333, 899):
        rows[i] = rows[i][:-3]
    lines(tmp_path / "f.jsonl", rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        bad = jsonl.bad_lines(spark, str(tmp_path), MATH_ITEM)
        assert sorted(r.line for r in bad.collect()) == [1, 334, 900]
        good = jsonl.read_items(spark, str(tmp_path), MATH_ITEM, bad="quarantine")
        assert good.count() == 897
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_an_append_that_died_or_was_repeated_counts_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "r")
    first, second = choices(spark, 30, 1), choices(spark, 20, 2, start=100)
    assert jsonl.write_results(first, folder, call="one")
    assert jsonl.read_results(spark, folder, "choice").count() == 30

    def dies(*_):
        raise KeyboardInterrupt

    # Dead before its record, when its files are in place already.
    monkeypatch.setattr(calls, "_record", dies)
    with pytest.raises(KeyboardInterrupt):
        jsonl.write_results(second, folder, "append", call="two")
    monkeypatch.undo()
    assert len(list((tmp_path / "r").glob("*.json"))) > len(calls.recorded(spark, folder)[0].files)
    assert jsonl.read_results(spark, folder, "choice").count() == 30
    # Dead while it moved its files.
    moved = []

    def moves_one(self, source, target):
        if moved:
            raise KeyboardInterrupt
        moved.append(target)
        assert self.store.rename(source, target)

    with monkeypatch.context() as m:
        m.setattr(calls.Folder, "move", moves_one)
        with pytest.raises(KeyboardInterrupt):
            jsonl.write_results(second.repartition(3), folder, "append", call="two")
    assert jsonl.read_results(spark, folder, "choice").count() == 30
    assert jsonl.write_results(second, folder, "append", call="two")
    assert not jsonl.write_results(second, folder, "append", call="two")
    back = jsonl.read_results(spark, folder, "choice")
    assert back.count() == 50 and back.select("seq").distinct().count() == 50
    # Calls without a name are calls of their own.
    jsonl.write_results(second, folder, "append")
    assert jsonl.read_results(spark, folder, "choice").count() == 70
    # Writing over replaces all, and what died left nothing behind.
    jsonl.write_results(first, folder, call="two")
    assert jsonl.read_results(spark, folder, "choice").count() == 30
    assert len(list((tmp_path / "r").glob("*.json"))) == len(calls.recorded(spark, folder)[0].files)


def test_files_from_elsewhere_come_before_the_first_call(spark, tmp_path):
    folder = str(tmp_path / "r")
    choices(spark, 10, 1).write.partitionBy("subject").json(folder)
    jsonl.write_results(choices(spark, 5, 2), folder, "append", partition_by=("subject",))
    assert [c.number > 0 for c in calls.recorded(spark, folder)] == [False, True]
    back = jsonl.read_results(spark, folder, "choice")
    assert back.count() == 15 and back.filter("order.batch = 0").count() == 10
    assert set(back.select("subject").distinct().toPandas()["subject"]) <= {f"s{i}" for i in range(4)}
    one = jsonl.read_results(spark, folder, "choice", "subject = 's1'")
    assert one.count() == back.filter("subject = 's1'").count()


def plain_running(batches):
    seen, out = {}, []
    for rows in batches:
        for r in sorted(rows, key=lambda r: r["seq"]):
            seen.setdefault(r["question"], (r["subject"], r["pred"] == r["label"]))
        n, c, report = 0, 0, []
        for s in sorted({s for s, _ in seen.values()}):
            hits = [h for t, h in seen.values() if t == s]
            n, c = n + len(hits), c + sum(hits)
            report.append((s, n, c, pytest.approx(c / n)))
        out.append(report)
    return out


def test_a_growing_folder_is_read_once(spark, tmp_path):
    folder, state = str(tmp_path / "r"), str(tmp_path / "state")
    batches = [choices(spark, 25, s, start=-100 * s) for s in range(4)]
    want = plain_running([b.collect() for b in batches])
    for k, rows in enumerate(batches):
        jsonl.write_results(rows, folder, "append" if k else "overwrite", call=f"c{k}")
        for file in calls.recorded(spark, folder)[k - 1].files if k else ():
            # What was read before isn't read again.
            (tmp_path / "r" / file).write_text("cut", "utf-8")
        assert growing.absorb(spark, folder, state) == 1
        assert growing.absorb(spark, folder, state) == 0
        got = growing.running_accuracy(spark, state).orderBy("subject").collect()
        assert [tuple(r) for r in got] == want[k]
        total = growing.accuracy(spark, state).first()
        assert (total.num_q, total.correct) == want[k][-1][1:3]


def test_a_step_that_died_is_made_again(spark, tmp_path, monkeypatch):
    folder, state = str(tmp_path / "r"), str(tmp_path / "state")
    batches = [choices(spark, 25, s) for s in range(2)]
    jsonl.write_results(batches[0], folder)
    growing.absorb(spark, folder, state)
    jsonl.write_results(batches[1], folder, "append")
    with monkeypatch.context() as m:
        m.setattr(calls, "_record", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            growing.absorb(spark, folder, state)
    assert growing.absorb(spark, folder, state) == 1
    want = plain_running([b.collect() for b in batches])[1]
    assert [tuple(r) for r in growing.running_accuracy(spark, state).orderBy("subject").collect()] == want


def test_late_calls_and_rewritten_folders(spark, tmp_path):
    folder, state = str(tmp_path / "r"), str(tmp_path / "state")
    batches = [choices(spark, 25, s) for s in range(3)]
    jsonl.write_results(batches[0], folder)
    growing.absorb(spark, folder, state)
    late = calls.recorded(spark, folder)[0].number + 1
    jsonl.write_results(batches[2], folder, "append")
    growing.absorb(spark, folder, state)
    # A slow writer, who began before.
    calls.add(batches[1].withColumn("batch", F.lit(late)), folder, "json", number=late)
    assert growing.absorb(spark, folder, state) == 1
    want = plain_running([b.collect() for b in batches])[2]
    assert [tuple(r) for r in growing.running_accuracy(spark, state).orderBy("subject").collect()] == want
    jsonl.write_results(batches[1], folder)
    assert growing.absorb(spark, folder, state) == 1
    want = plain_running([batches[1].collect()])[0]
    assert [tuple(r) for r in growing.running_accuracy(spark, state).orderBy("subject").collect()] == want
    with pytest.raises(ValueError, match="write_results"):
        batches[0].write.json(str(tmp_path / "other"))
        growing.absorb(spark, str(tmp_path / "other"), state)


@pytest.mark.parametrize("task", ["choice", "math"])
def test_levels_equal_a_call_for_each(spark, task):
    r = random.Random(3)
    rows = [
        (i, f"q{r.randrange(30)}", f"g{r.randrange(30)}", float(r.randrange(2)), 1.0, r.choice(["a", "b", None]), f"s{r.randrange(3)}")
        for i in range(400)
    ]
    made = spark.createDataFrame(
        rows, "seq bigint, question string, original_sln string, pred double, label double, run string, subject string")
    if task == "choice":
        made = made.withColumn("pred", F.col("pred").cast("string")).withColumn("label", F.lit("1.0"))
    levels = [("run", "subject"), ("subject",), ("run",), ()]
    got = defaultdict(set)
    for row in metrics.levels_accuracy(made, levels, task).collect():
        got[row.level].add(tuple(row)[1:])
    for level in levels:
        want = set()
        for row in evaluation.score(made, task, by=level).collect():
            own = row.asDict()
            want.add((own.get("run"), own.get("subject"), *(own[c] for c in ("num_q", "correct", "ratio"))))
        assert got[",".join(level)] == want


def test_levels_of_metrics_without_first_wins(spark):
    rows = spark.createDataFrame(
        [("a", "x", ["yes it is"], "yes."), ("a", "y", ["no"], "yes."), (None, "x", ["yes"], "")],
        "run string, subject string, label array<string>, pred string")
    got = {(r.level, r.run): (r.num_q, r.correct, r.n_empty) for r in metrics.levels_metrics(rows, [("run",), ()], metrics.qa_accuracy).collect()}
    assert got == {("run", "a"): (2, 1, 0), ("run", None): (1, 1, 1), ("", None): (3, 2, 1)}


def test_columns_logged_apart_are_zipped(spark, tmp_path):
    for name, n in (("a", 500), ("b", 470), ("c", 900)):
        for f in range(4):
            lines(tmp_path / name / f"{f}.jsonl", [json.dumps({name: i}) for i in range(n) if i * 4 // n == f])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        tables = [jsonl.read_items(spark, str(tmp_path / c), f"{c} bigint") for c in "abc"]
        got = sorted(tuple(r) for r in gather.zipped(tables).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, i, i, i) for i in range(470)]


@pytest.mark.parametrize("total, batch, workers", [(50, 4, 3), (48, 4, 3), (7, 1, 2), (3, 4, 3), (53, 5, 4)])
def test_results_of_workers_come_in_order(spark, tmp_path, total, batch, workers):
    questions = [f"q{i}" for i in range(total)]
    rounds = math.ceil(total / (batch * workers))
    filled = [questions[i % total] for i in range(rounds * batch * workers)]
    for w in range(workers):
        own = [q for i, q in enumerate(filled) if i // batch % workers == w]
        for f in range(2):  # a worker may have several files
            lines(tmp_path / f"worker={w}" / f"{f}.jsonl", [json.dumps({"question": q}) for q in own[f * len(own) // 2 : (f + 1) * len(own) // 2]])
    rows = jsonl.read_items(spark, str(tmp_path), "question string")
    for known in (None, total):
        got = gather.gathered(rows, "worker", workers, batch, total=known).orderBy("seq").collect()
        assert [(r.seq, r.question) for r in got] == list(enumerate(questions))
    # Without filling up, the last round is uneven.
    uneven = rows.filter(F.col("question").isNotNull())
    assert gather.gathered(uneven, "worker", workers, batch, total=total + 1).count() == min(total + 1, len(filled))


def test_missing_and_repeated_steps(spark):
    rows = [("a", s, f"t{s}") for s in (0, 3, 4, 4, 9)] + [("b", s, "x") for s in (0, 1, 2)] + [("c", 2, "x"), ("c", 2, "y"), ("c", 2, "z")]
    picks = spark.createDataFrame(rows, "example_id string, step int, next_token string")
    got = {r.example_id: r for r in sequences.assemble(picks, ["example_id"], token_id=None).collect()}
    assert [(g.start, g.stop) for g in got["a"].missing_steps] == [(1, 2), (5, 8)]
    assert (got["a"].n_missing, got["a"].repeated_steps, got["a"].text) == (6, [4], "t0t3t4t4t9")
    assert (got["b"].missing_steps, got["b"].repeated_steps, got["b"].n_missing) == ([], [], 0)
    assert [(g.start, g.stop) for g in got["c"].missing_steps] == [(0, 1)] and got["c"].repeated_steps == [2]
    known = {r.example_id: r for r in sequences.assemble(picks, ["example_id"], token_id=None, expected=6).collect()}
    assert [(g.start, g.stop) for g in known["a"].missing_steps] == [(1, 2), (5, 5)]
    assert [(g.start, g.stop) for g in known["b"].missing_steps] == [(3, 5)]


def test_steps_that_are_no_numbers_are_assembled(spark):
    picks = spark.createDataFrame([(1, 2, 0, "b"), (1, 1, 1, "a")], "example_id int, turn int, nth int, next_token string")
    got = sequences.assemble(picks.withColumn("step", F.struct("turn", "nth")), ["example_id"], token_id=None).first()
    assert (got.text, got.n_steps) == ("ab", 2)


def test_padding_keeps_rows_without_batch_or_ids(spark):
    rows = [(1, [1, 2, 3]), (1, None), (1, []), (None, [4]), (None, [5, 6])]
    got = sequences.left_pad(spark.createDataFrame(rows, "batch_id int, ids array<int>"), pad_id=9).collect()
    assert sorted((str(r.batch_id), r.padded, r.mask) for r in got) == sorted([
        ("1", [1, 2, 3], [1, 1, 1]), ("1", [9, 9, 9], [0, 0, 0]), ("1", [9, 9, 9], [0, 0, 0]),
        ("None", [9, 4], [0, 1]), ("None", [5, 6], [1, 1]),
    ])


def test_an_empty_prompt_is_one(spark, tmp_path):
    (tmp_path / "p.txt").write_text("")
    assert jsonl.read_prompt(spark, str(tmp_path / "p.txt")) == ""


def test_no_subject_loses_rows(spark, tmp_path):
    names = ["c++", "100%", "50%41", "plain", "a b", "sl/ash", "sl%2Fash", "_hidden", ".dot", "co:lon", "x.y", "é%"]
    rows = [(n, i, f"{n}{i}") for n in names for i in range(60)]
    items = spark.createDataFrame(rows, "subject string, nth int, question string")
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        jsonl.write_subjects(items, str(tmp_path / "s"), "nth")
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    back = jsonl.read_subjects(spark, str(tmp_path / "s"), CHOICE4_ITEM)
    counts = {r["subject"]: r["count"] for r in back.groupBy("subject").count().collect()}
    assert counts == dict.fromkeys(names, 60)
    assert sorted(p.name for p in (tmp_path / "s").glob("subject=*")) == []


def test_a_taken_name_is_an_error(spark, tmp_path):
    items = spark.createDataFrame([("a", 1, "q")], "subject string, nth int, question string")
    place = calls.Folder(spark, str(tmp_path))
    (tmp_path / "x").write_text("1")
    (tmp_path / "y").write_text("2")
    with pytest.raises(FileExistsError):
        place.move(place.at("x"), place.at("y"))
    assert items.count() == 1
