"""Scores of a result folder that grows, without reading it again.

The *state* is a folder of Parquet with one row for each question seen: its compact key (a digest),
its subject, whether its first record is right, and that record's order.  A step reads the
calls that were recorded since, and only their files; questions that the state holds
are left out, the others added.  The step is itself one recorded call, named after the results' last call it has read, so a
step that dies may be made again, and one that is repeated changes nothing.

A later call comes later in order, so a question's first record is settled once it was seen, and the state only
grows.  A call that is recorded after a later one (a slow writer) may hold earlier records; then the state is
merged as a whole and replaced.  A results folder that was written over starts a new state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logitblend.operators import metrics
from logitblend.operators.dedup import KEY, first_values
from logitblend.sources import calls, jsonl

_VALUES = ["subject", "hit"]


def _read(spark: SparkSession, state: str, known: list[calls.Call]) -> DataFrame | None:
    reader, files = calls.open_files(spark, state, spark.read, known)
    return reader.parquet(*files) if files else None


def absorb(
    spark: SparkSession, results: str, state: str, task: str = "choice", by: Sequence[str] = ()
) -> int:
    """Bring the state up to what is recorded in the results; the number of calls that were read."""
    there = calls.recorded(spark, results)
    if there is None:
        raise ValueError(f"{results} was not written by write_results, so its calls aren't known")
    known = calls.recorded(spark, state) or []
    seen = _numbers_seen(known)
    start = [c for c in there if c.replaces]
    stale = bool(seen) and bool(start) and start[-1].number not in seen
    if stale:
        seen = set()
    new = [c for c in there if c.number not in seen]
    if not new and not stale:
        return 0
    late = bool(seen) and new[0].number < max(seen)
    rows = jsonl.read_results(spark, results, task, only=new)
    subject = F.col("subject") if "subject" in rows.columns else F.lit(None).cast("string")
    key, hit = ("original_sln", metrics.number_hit()) if task == "math" else ("question", metrics.choice_hit())
    values = {"subject": subject, "hit": hit.cast("int")}
    fresh = first_values(rows, key, values, by, "order", keep_order=True)
    old = _read(spark, state, known) if seen else None
    whole = [*by, *KEY]
    if old is not None and late:
        first = F.min_by(F.struct(*_VALUES), "_order").alias("_first")
        merged = old.unionByName(fresh).groupBy(*whole).agg(first, F.min("_order").alias("_order"))
        fresh = merged.select("*", "_first.*").drop("_first")
    elif old is not None:
        same = _same(whole)
        fresh = fresh.alias("a").join(old.select(*whole).alias("b"), same, "left_anti")
    numbers = sorted(seen | {c.number for c in new})
    name = f"{numbers[0]}-{numbers[-1]}-{len(numbers)}"
    replace = stale or late or not known
    calls.add(fresh.select(*whole, *_VALUES, "_order"), state, "parquet", name, replace, note=numbers)
    return len(new)


def _same(columns: Sequence[str]):
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return condition


def _numbers_seen(known: list[calls.Call]) -> set[int]:
    return set(known[-1].note) if known else set()


def _questions(spark: SparkSession, state: str) -> DataFrame:
    rows = _read(spark, state, calls.recorded(spark, state) or [])
    if rows is None:
        raise ValueError(f"nothing was absorbed into {state}")
    return rows


def accuracy(spark: SparkSession, state: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy over all questions seen, as over the whole results folder."""
    return metrics.count_hits(_questions(spark, state), by)


def running_accuracy(spark: SparkSession, state: str, by: Sequence[str] = ()) -> DataFrame:
    """Running accuracy over the subjects of all questions seen."""
    counts = metrics.count_hits(_questions(spark, state), [*by, "subject"])
    return metrics.running_totals(counts, by)
