"""Run names and task routing from paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path parts that name a task, in routing order; the last one
# found wins.
TASK_MARKERS = (
    ("math", ("gsm",)),
    ("qa", ("triviaqa", "nq")),
    ("choice4", ("arc",)),
    ("choice2", ("piqa",)),
)
# The open-QA path parts of single-model runs.
BASELINE_QA_MARKERS = ("triviaqa", "naturalquestions")
# Which scorer goes with which task.
SCORERS = {"math": "math", "qa": "qa", "choice4": "choice", "choice2": "choice"}
# Characters (not a suffix) stripped from the end of a model name.
NAME_END = r"[-hf]+\z"


def _found(path: Column, markers: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(F.lower(path), F.lit(m))
    return hit


def _routes(baseline: bool):
    for task, markers in TASK_MARKERS:
        yield task, BASELINE_QA_MARKERS if baseline and task == "qa" else markers


def task_of(path: Column, baseline: bool = False) -> Column:
    """The task whose prompt a path's rows get; null if none is named."""
    task = F.lit(None).cast("string")
    for name, markers in _routes(baseline):
        task = F.when(_found(path, markers), F.lit(name)).otherwise(task)
    return task


def scorers_of(path: Column, baseline: bool = False) -> Column:
    """All scorers a path asks for; every match runs."""
    each = [F.when(_found(path, m), F.lit(SCORERS[t])) for t, m in _routes(baseline)]
    return F.array_distinct(F.array_compact(F.array(*each)))


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def last_part(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_parts(path), F.lit(-1)), F.lit(""))


def parent_part(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_parts(path), F.lit(-2)), F.lit(""))


def model_name(path: Column) -> Column:
    return F.regexp_replace(last_part(path), NAME_END, "")


def ensemble_run_name(model_1: Column, model_2: Column, test_set: Column) -> Column:
    return F.concat(
        model_name(model_1), F.lit("_"), model_name(model_2), F.lit("_"),
        parent_part(test_set), F.lit(".jsonl"),
    )


def baseline_run_name(model: Column, test_set: Column) -> Column:
    """Dataset folder and last path part, taken literally between slashes."""
    dataset = F.try_element_at(F.split(test_set, "/"), F.lit(-2))
    name = F.try_element_at(F.split(model, "/"), F.lit(-1))
    return F.concat(F.coalesce(dataset, F.lit("")), F.lit("_"), name, F.lit(".jsonl"))
