"""Expressions over one logit vector.  Each works inside its row: no explode,
no shuffle, whatever the vocabulary size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces a vector is cut into when looking for its largest entries.
PIECES = 256


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, even where
    ``body`` uses it inside a lambda that runs per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(scores: Column) -> Column:
    def normalise(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, e: acc + e)
        return bind(total, lambda t: F.transform(exps, lambda e: e / t))

    shifted = bind(
        F.array_max(scores).cast("double"),
        lambda top: F.transform(scores, lambda x: F.exp(x.cast("double") - top)),
    )
    return bind(shifted, normalise)


def top_k(logits: Column, k: int) -> Column:
    """The ``k`` largest entries as ``array<struct<pos, score, token_id>>``,
    ranked from 1, equal scores by token id.

    Sorting a whole vocabulary-sized vector costs far more than the rest of
    the row's work.  The k-th largest of the piece maxima is a lower bound for
    the k-th largest entry, so only entries reaching it, in pieces whose maximum
    reaches it, are sorted.  The bound is exact for any data; with fewer
    than ``k`` pieces it is null and everything is kept.
    """
    size = F.size(logits)
    pieces = max(PIECES, 8 * k)
    width = F.greatest(F.ceil(size / F.lit(pieces)).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), width)

    def ranked(parts: Column) -> Column:
        maxima = F.sort_array(F.transform(parts, lambda p: p["top"]), asc=False)
        return bind(F.get(maxima, F.lit(k - 1)), lambda bound: entries(parts, bound))

    def entries(parts: Column, bound: Column) -> Column:
        def reaching(part: Column) -> Column:
            scored = F.transform(
                F.slice(logits, part["start"] + 1, width),
                lambda x, i: F.struct(
                    x.alias("score"), (-(part["start"] + i)).alias("minus_id")
                ),
            )
            return F.filter(
                scored,
                lambda e: e["score"].isNotNull() & (bound.isNull() | (e["score"] >= bound)),
            )

        kept = F.filter(parts, lambda p: bound.isNull() | (p["top"] >= bound))
        best = F.sort_array(F.flatten(F.transform(kept, reaching)), asc=False)
        return F.transform(
            F.slice(best, 1, k),
            lambda e, i: F.struct(
                (i + 1).alias("pos"),
                e["score"].alias("score"),
                (-e["minus_id"]).alias("token_id"),
            ),
        )

    parts = F.transform(
        starts,
        lambda s: F.struct(
            F.array_max(F.slice(logits, s + 1, width)).alias("top"), s.alias("start")
        ),
    )
    return bind(parts, ranked)


def confidence(scores: Column) -> Column:
    """Largest softmax probability of a set of scores."""
    return bind(
        F.array_max(scores).cast("double"),
        lambda top: F.lit(1.0)
        / F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top)),
    )


def left_pad(ids: Column, width: Column, pad_id: int) -> Column:
    missing = (width - F.size(ids)).cast("int")
    return F.concat(F.array_repeat(F.lit(pad_id).cast("int"), missing), ids)


def left_pad_mask(ids: Column, width: Column) -> Column:
    missing = (width - F.size(ids)).cast("int")
    return F.concat(F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), F.size(ids)))
