"""Scores for the tokens a model did not propose itself.

A model's tokens at a step are few (models x k), and are read, put in order and normalised
as one array; only the result has a row for each token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logitblend.functions import half
from logitblend.functions.text import SPACE_MARKER, normalize_token
from logitblend.functions.vectors import bind
from logitblend.operators.candidates import MODEL_KEYS
from logitblend.operators.dimensions import Dimension, join_dimension
from logitblend.profiles import ModelProfile, per_model
from logitblend.schemas import STEP_KEYS


def vocab_lookup(vocab: DataFrame, normalize_vocab: bool = False) -> DataFrame:
    """Token to id, by the vocabulary's own spelling (``lookup``) or by the common
    one (``token``).  Id 0 stands for an unknown token and is no hit."""
    token = F.col("token")
    key = normalize_token(token).alias("token") if normalize_vocab else token.alias("lookup")
    known = vocab.filter(F.col("token_id") != 0).select("model", key, "token_id")
    return known.groupBy(*known.columns[:2]).agg(F.min("token_id").alias("vocab_id"))


def first_subtokens(subtokens: DataFrame, profiles: Sequence[ModelProfile]) -> DataFrame:
    """The id standing for a token that is not in the vocabulary: its first
    sub-token, leaving out blank ids for models set to skip them."""
    is_blank = per_model(profiles, "blank_skip", "boolean") & F.col("token_id").eqNullSafe(
        per_model(profiles, "blank_id", "int")
    )
    return (
        subtokens.filter(~is_blank)
        .groupBy("model", F.col("token").alias("lookup"))
        .agg(F.min_by("token_id", "pos").alias("subtoken_id"))
    )


def resolve_ids(
    sets: DataFrame,
    vocab_ids: DataFrame | Dimension,
    subtoken_ids: DataFrame | Dimension,
    profiles: Sequence[ModelProfile],
) -> DataFrame:
    """Give every missing token an id in its model.  ``source`` says how it was
    found: own, unnamed (own, but not in the vocabulary), vocab, subtoken, blank or
    unresolved."""
    marker = per_model(profiles, "marker", "string")
    lookup = F.when(
        marker.isNotNull(), F.replace(F.col("token"), F.lit(SPACE_MARKER), marker)
    ).otherwise(F.col("token"))
    own, empty = F.col("token_id").isNotNull(), F.col("token") == ""
    # Own, unnamed and empty tokens need no lookup; a null key matches nothing.
    keyed = sets.withColumn("lookup", F.when(~own & ~empty & F.col("named"), lookup)).withColumn(
        "plain", F.col("token")
    ).withColumn("token", F.when(F.col("named"), F.col("token")))
    for ids in (vocab_ids, subtoken_ids):
        columns = ids.table.columns if isinstance(ids, Dimension) else ids.columns
        key = "lookup" if "lookup" in columns else "token"
        keyed = join_dimension(keyed, ids, ["model", key], "left", [*STEP_KEYS, "plain"])
    blank_id = per_model(profiles, "blank_id", "int")
    found = (
        F.when(own, F.col("token_id"))
        .when(empty, blank_id)
        .otherwise(F.coalesce("vocab_id", "subtoken_id"))
    )
    source = (
        F.when(own & F.col("named"), "own")
        .when(own, "unnamed")
        .when(empty & blank_id.isNotNull(), "blank")
        .when(~empty & F.col("vocab_id").isNotNull(), "vocab")
        .when(~empty & F.col("subtoken_id").isNotNull(), "subtoken")
        .otherwise("unresolved")
    )
    return keyed.select(
        *MODEL_KEYS, F.col("plain").alias("token"), "pos", "score", found.alias("token_id"),
        source.alias("source"), "vectors",
    )


_ENTRY = ("token", "pos", "score", "token_id", "source")
_FAR = (1 << 31) - 1


def _entry(e: Column, score: Column) -> Column:
    """An entry with its score; an id for which the model has none is marked."""
    beyond = score.isNull() & e["token_id"].isNotNull()
    return F.struct(
        e["token"].alias("token"),
        e["pos"].alias("pos"),
        score.alias("score"),
        e["token_id"].alias("token_id"),
        F.when(beyond, "out_of_range").otherwise(e["source"]).alias("source"),
    )


def _checked(entries: Column, faulty: Column) -> Column:
    """The entries, or an error where a model has more than one vector at a step: which of
    them counts is not ours to say."""
    where = F.concat_ws(" ", *[F.col(c).cast("string") for c in MODEL_KEYS])
    message = F.concat(F.lit("more than one vector per step and model: "), where)
    kind = "array<struct<token: string>>"
    refused = F.transform(F.raise_error(message).cast(kind), lambda e: entries[0])
    return F.when(faulty, refused).otherwise(entries)


def read_scores(sets: DataFrame, logits: DataFrame) -> DataFrame:
    """Read the missing scores out of the logit vectors: one row per step and model, with
    its tokens in ``entries``.

    The ids wanted at a step travel as one short array (at most models x union
    size), and the vectors stream past a hash table of those arrays.  The
    vectors are never sorted, collected or exploded.  They are shuffled once
    unless the table is already bucketed by the step keys, see
    ``sources.logits``.  A model without a logged vector at a step drops out there.
    """
    entry = F.struct("model", *_ENTRY, "vectors")
    wanted = sets.groupBy(*STEP_KEYS).agg(F.collect_list(entry).alias("wanted"))
    joined = wanted.hint("shuffle_hash").join(
        logits.select(*MODEL_KEYS, "logits"), STEP_KEYS, "inner"
    )
    own = F.filter("wanted", lambda e: e["model"] == F.col("model"))
    vectors = F.aggregate(own, F.lit(0), lambda n, e: n + F.coalesce(e["vectors"], F.lit(0)))
    at = half.reader(logits)
    read = F.transform(own, lambda e: _entry(e, F.coalesce(e["score"], at(e["token_id"]))))
    return joined.select(*MODEL_KEYS, _checked(read, vectors > 1).alias("entries"))


def read_scores_long(sets: DataFrame, logits: DataFrame) -> DataFrame:
    """As :func:`read_scores` for logits stored one row per token.  The rows stream past
    a hash table of the ids wanted at their step, and only those found go on.  A model
    that logged a step has own candidates there, so it has a row."""
    wanted = sets.groupBy(*MODEL_KEYS).agg(F.collect_list(F.struct(*_ENTRY)).alias("wanted"))
    wanted = wanted.withColumn("ids", F.transform("wanted", lambda e: e["token_id"]))
    hits = (
        wanted.hint("shuffle_hash")
        .join(logits.select(*MODEL_KEYS, "token_id", "logit"), MODEL_KEYS)
        .filter(F.array_contains("ids", F.col("token_id")))
        .groupBy(*MODEL_KEYS)
        .agg(
            F.first("wanted").alias("wanted"),
            F.collect_list(F.struct("token_id", "logit")).alias("found"),
        )
    )
    ids = F.transform("found", lambda f: f["token_id"])
    repeated = F.size(ids) > F.size(F.array_distinct(ids))
    read = F.transform(
        "wanted",
        lambda e: _entry(
            e,
            F.coalesce(
                e["score"],
                F.get(F.filter("found", lambda f: f["token_id"] == e["token_id"]), F.lit(0))["logit"],
            ),
        ),
    )
    return hits.select(*MODEL_KEYS, _checked(read, repeated).alias("entries"))


def ordered(entries: Column) -> Column:
    """Entries in the order that settles ties everywhere below: own tokens by rank, then
    filled tokens by token."""
    keyed = F.transform(
        entries,
        lambda e: F.struct(
            F.coalesce(e["pos"], F.lit(_FAR)).alias("rank"),
            *[e[c].alias(c) for c in ("token", "score", "token_id", "source")],
        ),
    )
    return F.sort_array(keyed)


def suppressed(entries: Column, wanted: Column) -> Column:
    """Ordered entries, numbered.  Where ``wanted``, a filled-in token's score is 0 if an
    own token or an earlier filled-in one has the same id; ``repeated`` tells."""

    def with_ids(ids: Column) -> Column:
        def entry(e: Column, i: Column) -> Column:
            again = F.coalesce(F.array_position(ids, e["token_id"]) <= i, F.lit(False))
            again = wanted & ~e["source"].isin("own", "unnamed") & again
            return F.struct(
                (i + 1).alias("pos"),
                F.when(again, F.lit(0).cast("double")).otherwise(e["score"]).alias("score"),
                *[e[c].alias(c) for c in ("token", "token_id", "source")],
                again.alias("repeated"),
            )

        return F.transform(entries, entry)

    return bind(F.transform(entries, lambda e: e["token_id"]), with_ids)
