"""Accuracy, error and match rates over result tables.

Every metric takes optional grouping columns (run, dataset, ...) and is one
aggregate, after a first-wins aggregate on the question where repeated
questions count once.  Whether a row is right is decided before anything is
shuffled, so the long text columns stay behind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logitblend.functions.text import drop_last_char, strip
from logitblend.operators.dedup import KEY as _KEY
from logitblend.operators.dedup import first_values, short_order


def same_number(a: Column, b: Column) -> Column:
    """Equality under which NaN equals nothing, not even NaN."""
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & (a == b), F.lit(False))


def to_number(value: Column) -> Column:
    """Number from text, NaN where it is none.  Java's type suffixes are not numbers."""
    text = strip(value.cast("string"))
    suffixed = F.rlike(text, F.lit(r"(?i)^[^a-z]*[df]$"))
    return F.coalesce(F.when(~suffixed, text.try_cast("double")), F.lit(float("nan")))


def count_hits(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    return (
        hits.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("num_q"),
            F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("correct"),
        )
        .withColumn("ratio", F.try_divide("correct", "num_q"))
    )


def _first_hits(
    rows: DataFrame, key: str, hit: Column, by: Sequence[str], order: str | None
) -> DataFrame:
    return first_values(rows, key, {"hit": hit.cast("int")}, by, order)


def math_accuracy(rows: DataFrame, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Numeric accuracy, each gold solution counted once."""
    return count_hits(_first_hits(rows, "original_sln", number_hit(), by, order), by)


def number_hit() -> Column:
    return same_number(F.col("pred"), F.col("label"))


def choice_hit() -> Column:
    return F.coalesce(strip(F.col("pred")) == strip(F.col("label")), F.lit(False))


def choice_accuracy(rows: DataFrame, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Choice accuracy, each rendered question counted once."""
    return count_hits(_first_hits(rows, "question", choice_hit(), by, order), by)


def label_aliases(label: Column, type_: str, char_labels: bool = False) -> Column:
    """Gold aliases as an array, for array, string and variant labels.
    ``char_labels`` takes a plain string as a list of its characters."""

    def single(text: Column) -> Column:
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        return chars if char_labels else F.array(text)

    if type_.startswith("array"):
        return label
    if type_ == "variant":
        listed = F.try_variant_get(label, "$", "array<string>")
        text = F.try_variant_get(label, "$", "string")
        return F.coalesce(listed, F.when(text.isNotNull(), single(text)))
    return single(label)


def qa_accuracy(
    rows: DataFrame,
    by: Sequence[str] = (),
    empty_is_wrong: bool = False,
    char_labels: bool = False,
) -> DataFrame:
    """Open-QA accuracy: the prediction without its last character is part of
    some gold alias.  An empty one is part of every alias; ``n_empty`` tells how
    many there were, ``empty_is_wrong`` counts them as wrong."""
    aliases = label_aliases(F.col("label"), rows.schema["label"].dataType.simpleString(), char_labels)
    text = drop_last_char(F.col("pred"))
    hit = F.coalesce(
        F.exists("aliases", lambda gold: F.contains(gold, F.col("text"))), F.lit(False)
    )
    if empty_is_wrong:
        hit = hit & (F.col("text") != "")
    judged = rows.select(*by, text.alias("text"), aliases.alias("aliases")).select(
        *by, hit.cast("int").alias("hit"), (F.col("text") == "").cast("int").alias("empty")
    )
    return (
        judged.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("num_q"),
            F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("correct"),
            F.coalesce(F.sum("empty"), F.lit(0)).cast("bigint").alias("n_empty"),
        )
        .withColumn("ratio", F.try_divide("correct", "num_q"))
    )


def _number(rows: DataFrame, column: str) -> Column:
    value = F.col(column)
    if isinstance(rows.schema[column].dataType, T.NumericType):
        return F.coalesce(value.cast("double"), F.lit(float("nan")))
    return to_number(value)


def numeric_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rounded accuracy, mean absolute error and exact-match rate over all rows.

    A NaN is wrong in the two rates and left out of the error; ``n_nan`` counts
    the rows left out."""
    numbers = rows.select(*by, *[_number(rows, c).alias(c) for c in ("pred", "label")])
    pred, label = F.col("pred"), F.col("label")
    undefined = F.isnan(pred) | F.isnan(label)
    return numbers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(same_number(F.bround(pred, 0), label).cast("int")).alias("accuracy"),
        F.avg(F.when(~undefined, F.abs(label - pred))).alias("mae"),
        F.avg(same_number(pred, label).cast("int")).alias("exact_match"),
        F.coalesce(F.sum(undefined.cast("int")), F.lit(0)).cast("bigint").alias("n_nan"),
    )


def text_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates of predictions equal to the gold text, and containing it.

    In result files of open questions the gold text may also be a list of aliases; its
    text is then its JSON, which a prediction hardly equals (:func:`qa_accuracy` looks at the
    aliases)."""
    pred, gold = F.col("pred"), F.col("original_sln")
    if rows.schema["original_sln"].dataType.simpleString() == "variant":
        gold = F.try_variant_get(gold, "$", "string")
    exact = F.coalesce(pred == gold, F.lit(False)).cast("int")
    partial = F.coalesce(F.contains(pred, gold), F.lit(False)).cast("int")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(exact).alias("exact_match"),
        F.avg(partial).alias("partial_match"),
    )


def subject_hits(rows: DataFrame, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Counts per subject after removing repeated questions over all subjects.
    A repeated question counts for the subject it is first seen in."""
    values = {"subject": F.col("subject"), "hit": choice_hit().cast("int")}
    first = first_values(rows, "question", values, by, order)
    return count_hits(first, [*by, "subject"])


def subject_accuracy(rows: DataFrame, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    return subject_hits(rows, by, order)


def running_accuracy(rows: DataFrame, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Accuracy over all subjects up to and including each one, in name order."""
    return running_totals(subject_hits(rows, by, order), by)


def running_totals(counts_by_subject: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running accuracy from rows with ``num_q`` and ``correct`` of each subject.

    Running totals are taken within groups of subjects sharing a first letter,
    then shifted by the totals of the earlier groups, so that many subjects do
    not meet in one task; only one row per first letter does."""
    subjects = counts_by_subject.withColumn("initial", F.substring("subject", 1, 1))
    within = Window.partitionBy(*by, "initial").orderBy("subject").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*by).orderBy("initial").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = ["num_q", "correct"]
    running = subjects.select(
        *by, "subject", "initial", *[F.sum(c).over(within).alias(c) for c in counts]
    )
    earlier = (
        subjects.groupBy(*by, "initial")
        .agg(*[F.sum(c).alias(c) for c in counts])
        .select(*by, "initial", *[F.sum(c).over(before).alias(f"{c}_before") for c in counts])
    )
    # A left join adds no filter to one side only, so both sides share one
    # aggregation of the rows.  A missing run or subject is a group like any other.
    shifted = [
        (F.col(c) + F.coalesce(F.col(f"{c}_before"), F.lit(0))).alias(f"{c}_so_far")
        for c in counts
    ]
    keys = [*by, "initial"]
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    earlier = earlier.withColumnsRenamed({k: f"{k}_" for k in keys})
    return (
        running.join(earlier, same, "left")
        .select(*by, "subject", *shifted)
        .withColumn("acc_so_far", F.try_divide("correct_so_far", "num_q_so_far"))
    )


def average_running_accuracy(
    rows: DataFrame, by: Sequence[str] = (), order: str | None = None
) -> DataFrame:
    """Mean of the running accuracies: depends on the order of subjects."""
    return running_accuracy(rows, by, order).groupBy(*by).agg(
        F.avg("acc_so_far").alias("avg_acc")
    )


def macro_micro_accuracy(
    rows: DataFrame, by: Sequence[str] = (), order: str | None = None
) -> DataFrame:
    """Mean of the subject accuracies, and pooled accuracy."""
    return (
        subject_hits(rows, by, order)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_subjects"),
            F.avg("ratio").alias("macro_acc"),
            F.sum("num_q").alias("num_q"),
            F.sum("correct").alias("correct"),
        )
        .withColumn("micro_acc", F.try_divide("correct", "num_q"))
    )


def levels_accuracy(
    rows: DataFrame,
    levels: Sequence[Sequence[str]],
    task: str = "choice",
    order: str | None = None,
) -> DataFrame:
    """Accuracy at several levels at once, in one pass over the rows.  A level is a list of columns;
    the result has the columns of all levels, null where a level hasn't one, and ``level``, its columns' names.

    Which record of a question comes first is decided at each level: two runs may both have
    answered it.  The first of each question within all columns together is found first, with partial results
    in every task; only these rows are copied, once for each level."""
    key, hit = {
        "math": ("original_sln", number_hit()),
        "choice": ("question", choice_hit()),
    }[task]
    names = list(dict.fromkeys(c for level in levels for c in level))
    values = {"hit": hit.cast("int")}
    first = first_values(rows, key, values, names, order, keep_order=True)
    by = ["level", *names]
    first = first.withColumn("_order", short_order(first, "_order")[0])
    own = _copied(first, levels, names).groupBy(*by, *_KEY).agg(F.min_by("hit", "_order").alias("hit"))
    return count_hits(own, by)


def levels_metrics(
    rows: DataFrame, levels: Sequence[Sequence[str]], metric: Callable[..., DataFrame], **options
) -> DataFrame:
    """A metric in which each record counts by itself (open questions, numbers, texts) at several
    levels at once, as :func:`levels_accuracy` has them.  The rows are read once, and copied once
    for each level before the partial results of their task are computed."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    marked = _copied(rows, levels, names)
    return metric(marked, by=["level", *names], **options)


def _copied(rows: DataFrame, levels: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """Each row once for each level, with null in the columns that the level hasn't."""
    each = F.array(
        *[
            F.struct(
                F.lit(",".join(level)).alias("level"),
                *[(F.col(c) if c in level else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in names],
            )
            for level in levels
        ]
    )
    rest = [c for c in rows.columns if c not in names]
    return rows.select(*rest, F.inline(each))

