"""Per-model settings.  There are as many profiles as models in the blend, a
handful, so they enter a plan as literals rather than as a joined table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from logitblend.functions.text import UNDERSCORE_MARKER

# The id each model family uses for an empty (blank) token.
BLANK_IDS = {
    "llama3": 220,
    "qwen2": 220,
    "llama2": 29871,
    "mistral": 29473,
    "deepseek": 207,
    "openchat": 28705,
    "glm": 128,
}
# Families whose vocabulary marks a leading space with U+2581.
UNDERSCORE_MARKER_KINDS = ("llama2", "mistral", "deepseek", "openchat")


@dataclass(frozen=True)
class ModelProfile:
    model: int
    kind: str = ""
    weight: float = 0.5
    marker: str | None = None
    """Space marker of this vocabulary when it is not the common one."""
    blank_id: int | None = None
    dedup_ids: bool = True
    """Give a filled-in token logit 0 when its id is already in the set."""
    blank_skip: bool = True
    """Ignore the blank id when falling back to sub-tokens."""


def profile_for_kind(
    model: int,
    kind: str,
    weight: float = 0.5,
    *,
    subject_sweep: bool = False,
    literal_blank_skip: bool = False,
) -> ModelProfile:
    """Profile of a model family.

    Blank ids go by substring of ``kind``, marker handling by its exact name.
    ``subject_sweep`` gives the rules of the per-subject runs: no marker
    mapping, repeated ids kept, no blank id for the openchat and glm families.
    ``literal_blank_skip`` limits the blank skip to the one family for which
    it has an effect there (openchat; deepseek in subject sweeps).
    """
    left_out = ("openchat", "glm") if subject_sweep else ()
    blank_id = None
    for family, token_id in BLANK_IDS.items():
        if family in kind and family not in left_out:
            blank_id = token_id
    marked = kind in UNDERSCORE_MARKER_KINDS and not subject_sweep
    skipping = "deepseek" if subject_sweep else "openchat"
    return ModelProfile(
        model=model,
        kind=kind,
        weight=weight,
        marker=UNDERSCORE_MARKER if marked else None,
        blank_id=blank_id,
        dedup_ids=not marked and not subject_sweep,
        blank_skip=skipping in kind if literal_blank_skip else True,
    )


def two_model_weights(profiles: Sequence[ModelProfile], lam: float) -> list[ModelProfile]:
    first, second = profiles
    return [replace(first, weight=lam), replace(second, weight=1.0 - lam)]


def uniform_weights(profiles: Sequence[ModelProfile]) -> list[ModelProfile]:
    return [replace(p, weight=1.0 / len(profiles)) for p in profiles]


def per_model(profiles: Sequence[ModelProfile], attribute: str, type_: str) -> Column:
    """The attribute's value for the row's ``model`` column."""
    value = F.lit(None).cast(type_)
    for p in profiles:
        value = F.when(
            F.col("model") == p.model, F.lit(getattr(p, attribute)).cast(type_)
        ).otherwise(value)
    return value
