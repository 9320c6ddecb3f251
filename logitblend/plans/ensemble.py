"""From logged logits to one chosen token per step.

Shuffles: the k candidates of each vector by step (narrow), and the vectors
themselves by step (wide).  Everything after the first, from union to pick,
groups by the step keys or more, so it stays in place.  Over a table written by
``sources.logits`` there is no shuffle, and one scan of the vectors instead of two; that
is the form for large tables.  Logits stored one row per token move by step once, for
ranking and reading alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logitblend.operators import blending, candidates, filling, sequences
from logitblend.operators.candidates import MODEL_KEYS
from logitblend.operators.dimensions import Dimension, dimensions
from logitblend.profiles import ModelProfile, per_model
from logitblend.schemas import STEP_KEYS


def _measured(*tables: DataFrame | Dimension) -> list[Dimension]:
    if all(isinstance(t, Dimension) for t in tables):
        return list(tables)
    return dimensions(*[t.table if isinstance(t, Dimension) else t for t in tables])


def _long_by_step(logits: DataFrame, colocated: bool) -> DataFrame:
    """Long rows, moved by step: one shuffle for ranking and for reading scores.  The join
    would drop rows without a key on its side only, and make it two; here both sides do."""
    keys = [*MODEL_KEYS, "token_id"]
    whole = logits.select(*keys, "logit").filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return whole if colocated else whole.repartition(*STEP_KEYS)


def own_candidates(
    logits: DataFrame, vocab: DataFrame | Dimension, k: int = 10, colocated: bool = False
) -> DataFrame:
    """Top-k candidates with common token spellings, rows of a step together.
    ``colocated`` says the logits are bucketed by the step keys already."""
    if "logits" in logits.columns:
        rows = candidates.top_k_rows(logits, k)
        if not colocated:
            rows = rows.repartition(*STEP_KEYS)
        ranked = candidates.unpack(rows)
    else:
        ranked = candidates.top_k_long(_long_by_step(logits, colocated), k)
    return candidates.merge_spellings(candidates.name_tokens(ranked, vocab))


def filled_sets(
    logits: DataFrame,
    vocab: DataFrame | Dimension,
    subtokens: DataFrame | Dimension,
    profiles: Sequence[ModelProfile],
    k: int = 10,
    colocated: bool = False,
    normalize_vocab: bool = False,
) -> DataFrame:
    """Every model's scores and probabilities over the union of all models' candidates."""
    vocab, subtokens = _measured(vocab, subtokens)
    vocab_ids = vocab.reduced(lambda t: filling.vocab_lookup(t, normalize_vocab))
    subtoken_ids = subtokens.reduced(lambda t: filling.first_subtokens(t, profiles))
    own = own_candidates(logits, vocab, k, colocated)
    sets = candidates.complete_sets(own, [p.model for p in profiles])
    sets = filling.resolve_ids(sets, vocab_ids, subtoken_ids, profiles)
    if "logits" in logits.columns:
        rows = filling.read_scores(sets, logits)
    else:
        rows = filling.read_scores_long(sets, _long_by_step(logits, colocated))
    entries = filling.suppressed(
        filling.ordered(F.col("entries")), per_model(profiles, "dedup_ids", "boolean")
    )
    # The arrays are built once a row; the select below only unpacks them.
    built = rows.select(*MODEL_KEYS, entries.alias("entries")).select(
        *MODEL_KEYS, blending.with_probabilities(F.col("entries")).alias("entries")
    )
    return built.select(*MODEL_KEYS, F.inline("entries"))


def blended(
    logits: DataFrame,
    vocab: DataFrame | Dimension,
    subtokens: DataFrame | Dimension,
    profiles: Sequence[ModelProfile],
    **options,
) -> DataFrame:
    """Mean distribution over the union, for any number of models."""
    sets = filled_sets(logits, vocab, subtokens, profiles, **options)
    return blending.blend(sets, profiles)


def picks(
    logits: DataFrame,
    vocab: DataFrame | Dimension,
    subtokens: DataFrame | Dimension,
    profiles: Sequence[ModelProfile],
    **options,
) -> DataFrame:
    """The chosen token of every step, with its mean probability and ids."""
    vocab, subtokens = _measured(vocab, subtokens)
    chosen = blending.pick(blended(logits, vocab, subtokens, profiles, **options))
    return blending.name_picks(chosen, vocab, profiles[0].model)


def generated_texts(
    logits: DataFrame,
    vocab: DataFrame | Dimension,
    subtokens: DataFrame | Dimension,
    profiles: Sequence[ModelProfile],
    **options,
) -> DataFrame:
    """The blended output text of every example."""
    chosen = picks(logits, vocab, subtokens, profiles, **options)
    return sequences.assemble(chosen, token_id=f"token_id_{profiles[0].model}")
