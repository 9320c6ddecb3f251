"""Joins to lookup tables whose size is measured first."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest lookup table sent to every executor.
MAX_BROADCAST_BYTES = 64 << 20
#: Copies of a larger lookup table, so that one hot key spreads over as many tasks.
SALTS = 32
_ROW_OVERHEAD = 64
_SALT = "_salt"


@dataclass(frozen=True)
class Dimension:
    """A lookup table, one row per join key, and whether it may be broadcast."""

    table: DataFrame
    small: bool

    def reduced(self, change: Callable[[DataFrame], DataFrame]) -> Dimension:
        """A table derived from this one that cannot be larger; not measured again."""
        return Dimension(change(self.table), self.small)


def _stored_bytes(table: DataFrame) -> Column:
    widths = [
        F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
        for c in table.columns
    ]
    total = sum(widths, F.lit(_ROW_OVERHEAD)).cast("bigint")
    return F.coalesce(F.sum(total), F.lit(0))


def dimensions(*tables: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> list[Dimension]:
    """Measure lookup tables, all in one job of one row per table."""
    sizes = [
        t.agg(_stored_bytes(t).alias("bytes")).select(F.lit(i).alias("i"), "bytes")
        for i, t in enumerate(tables)
    ]
    measured = {r["i"]: r["bytes"] for r in reduce(DataFrame.union, sizes).collect()}
    return [Dimension(t, measured[i] <= max_bytes) for i, t in enumerate(tables)]


def dimension(table: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> Dimension:
    return dimensions(table, max_bytes=max_bytes)[0]


def salt(spread_by: Sequence[str | Column], keys: Sequence[str] = ()) -> Column:
    """A repeatable salt for rows sharing a join key.  The row hash spreads
    rows that differ, the partition number spreads copies of one row.  Both stay
    the same when a lost task is run again, so no row is lost or doubled.

    Rows with a null key match nothing; they get salts outside the range of the
    copies, and many more of them, so that they are spread as well."""
    mixed = F.xxhash64(*spread_by) + F.spark_partition_id()
    matching = F.pmod(mixed, F.lit(SALTS)).cast("int")
    unmatched = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.lit(False))
    return F.when(unmatched, -1 - F.pmod(mixed, F.lit(1 << 20)).cast("int")).otherwise(matching)


def join_dimension(
    facts: DataFrame,
    dim: DataFrame | Dimension,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Join rows to their lookup row.

    A table measured as small is broadcast, so the facts do not move.  A larger
    one is copied once per salt, and facts with the same key go to different
    tasks by a salt over ``spread_by`` (by default all their other columns)."""
    if isinstance(dim, DataFrame):
        dim = dimension(dim)
    on = list(on)
    if dim.small:
        return facts.join(F.broadcast(dim.table), on, how)
    spread = list(spread_by or [c for c in facts.columns if c not in on] or on)
    copies = dim.table.withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    return facts.withColumn(_SALT, salt(spread, on)).join(copies, on + [_SALT], how).drop(_SALT)
