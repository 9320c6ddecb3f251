"""Candidate tokens of each model at each step.

Candidate tables are long: one row per (step, model, token).  Steps are told
apart by ``STEP_KEYS``; a step has at most (models x k) candidates, so no group
here grows with the data.  That rests on one vector per step and model, which
:func:`faulty_keys` checks beforehand, and every blend where it reads the scores.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logitblend.functions import half, vectors
from logitblend.functions.text import normalize_token
from logitblend.operators.dimensions import Dimension, join_dimension
from logitblend.schemas import STEP_KEYS

MODEL_KEYS = [*STEP_KEYS, "model"]

#: What stands in for the token of an id that the vocabulary doesn't list.
UNNAMED = "<unnamed "


def faulty_keys(logits: DataFrame) -> DataFrame:
    """Steps at which a model has more than one vector, and keys with nulls, which
    no join would find again.  Reads the key columns only, and counts before it
    shuffles."""
    missing = F.greatest(*[F.col(c).isNull() for c in MODEL_KEYS])
    counted = logits.groupBy(*MODEL_KEYS).agg(F.count(F.lit(1)).alias("vectors"))
    return counted.filter((F.col("vectors") > 1) | missing)


def stored_top(logits: DataFrame, k: int) -> str | None:
    """The narrowest column ``top_<n>`` holding at least k ranked entries."""
    sizes = [int(c[4:]) for c in logits.columns if re.fullmatch(r"top_\d+", c)]
    return f"top_{min(n for n in sizes if n >= k)}" if any(n >= k for n in sizes) else None


def top_k_rows(logits: DataFrame, k: int = 10) -> DataFrame:
    """One row per (step, model) with its ranked entries; a projection of the scan.

    Where the table was written with ranked entries, only those are read, not
    the vectors."""
    stored = stored_top(logits, k)
    top = F.slice(stored, 1, k) if stored else half.over_vector(logits, lambda v: vectors.top_k(v, k))
    return logits.select(*MODEL_KEYS, top.alias("top"))


def unpack(rows: DataFrame) -> DataFrame:
    """One row per entry of ``top``.

    The outer form keeps Catalyst from adding a filter on the array's size,
    which would move below and compute the whole top k a second time."""
    return rows.select(*MODEL_KEYS, F.inline_outer("top")).filter(F.col("pos").isNotNull())


def top_k(logits: DataFrame, k: int = 10) -> DataFrame:
    """The k highest logits of each vector, one row each."""
    return unpack(top_k_rows(logits, k))


def top_k_long(logits: DataFrame, k: int = 10) -> DataFrame:
    """As :func:`top_k` for logits stored one row per token.  The rank limit
    is applied before the shuffle as well as after it."""
    ranked = Window.partitionBy(*MODEL_KEYS).orderBy(F.desc("logit"), F.asc("token_id"))
    return (
        logits.withColumn("pos", F.row_number().over(ranked))
        .filter(F.col("pos") <= k)
        .select(*MODEL_KEYS, "pos", F.col("logit").alias("score"), "token_id")
    )


def top_k_softmax(logits: DataFrame, k: int = 10) -> DataFrame:
    """Each model's own distribution over its k candidates, before any union."""
    rows = top_k_rows(logits, k)
    probabilities = vectors.softmax(F.transform("top", lambda e: e["score"]))
    zipped = F.zip_with(
        "top", probabilities, lambda e, p: e.withField("p", p)
    )
    return unpack(rows.select(*MODEL_KEYS, zipped.alias("top")))


def confidence_trace(logits: DataFrame, k: int = 10) -> DataFrame:
    """Largest probability among each model's top k, per step."""
    scores = F.transform("top", lambda e: e["score"])
    return top_k_rows(logits, k).select(
        *MODEL_KEYS, vectors.confidence(scores).alias("confidence")
    )


def name_tokens(candidates: DataFrame, vocab: DataFrame | Dimension) -> DataFrame:
    """Add each candidate's token, in the spelling common to all models.

    Output layers are often wider than the vocabulary.  An id without a token stays a candidate, under a
    name that no other model has, and ``named`` tells."""
    listed = join_dimension(
        candidates, vocab, ["model", "token_id"], "left", spread_by=STEP_KEYS
    )
    stand_in = F.concat(F.lit(UNNAMED), "model", F.lit(":"), "token_id", F.lit(">"))
    return listed.withColumn("named", F.col("token").isNotNull()).withColumn(
        "token", F.coalesce(normalize_token(F.col("token")), stand_in)
    )


def merge_spellings(candidates: DataFrame) -> DataFrame:
    """Candidates whose spellings became equal are one: the best position, with
    the score and id of the last of them.  ``vectors`` counts first places: over the
    tokens of a step, how many vectors the model has there."""
    named = F.bool_and("named") if "named" in candidates.columns else F.lit(True)
    return candidates.groupBy(*MODEL_KEYS, "token").agg(
        F.min("pos").alias("pos"),
        F.max_by("score", "pos").alias("score"),
        F.max_by("token_id", "pos").alias("token_id"),
        F.count_if(F.col("pos") == 1).cast("int").alias("vectors"),
        named.alias("named"),
    )


def union_tokens(candidates: DataFrame) -> DataFrame:
    """The tokens any model proposes at a step."""
    return candidates.select(*STEP_KEYS, "token").distinct()


def complete_sets(candidates: DataFrame, models: Sequence[int]) -> DataFrame:
    """One row per union token and model.  Where the model did not propose the
    token, ``pos``, ``score`` and ``token_id`` are null.

    Candidates meet by one aggregate on the token, with a column for each model; neither
    an anti join nor a product of tokens and models is needed.
    """
    columns = ("pos", "score", "token_id", "vectors")
    of_model = [
        F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}_{m}")
        for m in models
        for c in columns
    ]
    per_token = candidates.groupBy(*STEP_KEYS, "token").agg(
        F.bool_and("named").alias("named"), *of_model
    )
    slots = F.array(
        *[
            F.struct(F.lit(m).alias("model"), *[F.col(f"{c}_{m}").alias(c) for c in columns])
            for m in models
        ]
    )
    return per_token.select(*STEP_KEYS, "token", "named", F.inline(slots)).select(
        *MODEL_KEYS, "token", "named", *columns
    )
