"""Distributions over the union of candidates, their mean, and the pick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logitblend.functions.vectors import bind
from logitblend.operators.dimensions import Dimension, join_dimension
from logitblend.profiles import ModelProfile
from logitblend.schemas import STEP_KEYS


def with_probabilities(entries: Column) -> Column:
    """The entries of a set with their probability ``p`` in it.  A token without a score has
    probability 0, and so has every token of a set without any; ``scored`` tells whether
    there is one.  A set with a score that is NaN or infinite has no probabilities either, as an overflow makes all of
    them NaN: it is not ``scored``, and ``faulty``.  Minus infinity is a score, that of a token that was
    masked, unless all are.  Sums run in the order of the entries."""

    def normalised(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda sum_, w: sum_ + w)
        return bind(
            total,
            lambda t: F.zip_with(
                entries,
                weights,
                lambda e, w: e.withField("p", F.coalesce(F.try_divide(w, F.nanvl(t, F.lit(0.0))), F.lit(0.0)))
                .withField("scored", ~F.isnan(t) & (t > 0))
                .withField("faulty", F.isnan(t)),
            ),
        )

    # The largest score is NaN if there is one; with it, or an infinite one, some weight is NaN, and
    # so is the total.
    scores = F.transform(entries, lambda e: e["score"].cast("double"))
    weights = bind(
        F.array_max(scores),
        lambda top: F.transform(
            entries, lambda e: F.coalesce(F.exp(e["score"].cast("double") - top), F.lit(0.0))
        ),
    )
    return bind(weights, normalised)


def drop_tokens(sets: DataFrame, threshold: float, model: int = 1) -> DataFrame:
    """Keep tokens whose score in one model is above a threshold, in all models."""
    token = Window.partitionBy(*STEP_KEYS, "token")
    reference = F.max(F.when(F.col("model") == model, F.col("score"))).over(token)
    return (
        sets.withColumn("reference", reference)
        .filter(F.col("reference") > threshold)
        .drop("reference")
    )


def blend(sets: DataFrame, profiles: Sequence[ModelProfile]) -> DataFrame:
    """Weighted mean distribution.  One row per union token with the mean ``p``,
    the position in the first model's set, the id in each model, how many models
    scored the step (fewer than all of them marks an incomplete log), how many have a NaN or
    infinite score there (``n_faulty``), and whether it is an id that its model's vocabulary doesn't list."""

    def of(profile: ModelProfile, column: str):
        return F.max(F.when(F.col("model") == profile.model, F.col(column)))

    first = profiles[0]
    # Sets from elsewhere may have probabilities alone.
    scored = F.col("scored") if "scored" in sets.columns else F.col("p").isNotNull()
    faulty = F.col("faulty") if "faulty" in sets.columns else F.isnan("p")
    unnamed = F.col("source") == "unnamed" if "source" in sets.columns else F.lit(False)
    aggregates = [
        of(first, "pos").alias("pos"),
        F.count_if(scored).alias("n_models"),
        F.count_if(faulty).alias("n_faulty"),
        F.bool_or(unnamed).alias("unnamed"),
    ]
    for m in profiles:
        aggregates += [
            of(m, "p").alias(f"p_{m.model}"),
            of(m, "token_id").alias(f"token_id_{m.model}"),
        ]
    # Added model by model: an aggregate sum would depend on row order.
    mean = sum(
        (F.coalesce(F.col(f"p_{m.model}"), F.lit(0.0)) * m.weight for m in profiles[1:]),
        F.coalesce(F.col(f"p_{first.model}"), F.lit(0.0)) * first.weight,
    )
    return (
        sets.groupBy(*STEP_KEYS, "token")
        .agg(*aggregates)
        .select(
            *STEP_KEYS, "token", "pos", mean.alias("p"), "n_models", "n_faulty", "unnamed",
            *[f"token_id_{m.model}" for m in profiles],
        )
    )


def pick(blended: DataFrame) -> DataFrame:
    """The most probable token of each step; equal probabilities go by the
    first model's set order."""
    best = Window.partitionBy(*STEP_KEYS).orderBy(
        F.desc("p"), F.asc_nulls_last("pos"), F.asc("token")
    )
    return (
        blended.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") == 1)
        .drop("place", "pos")
    )


def name_picks(picks: DataFrame, vocab: DataFrame | Dimension, model: int) -> DataFrame:
    """Add ``next_token``: the picked id's token in the first model's own spelling, and
    ``special`` where the vocabulary marks special tokens."""

    def own(table: DataFrame) -> DataFrame:
        marks = ["special"] if "special" in table.columns else []
        return table.filter(F.col("model") == model).select(
            F.col("token_id").alias(f"token_id_{model}"), F.col("token").alias("next_token"), *marks
        )

    names = vocab.reduced(own) if isinstance(vocab, Dimension) else own(vocab)
    return join_dimension(picks, names, [f"token_id_{model}"], "left", spread_by=STEP_KEYS)
