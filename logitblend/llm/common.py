"""What the operators of this folder share: free column names, small checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logitblend.sources.shared import written

STRETCH = 4096

__all__ = [
    "field_names",
    "fold",
    "fresh",
    "integer",
    "over_held_texts",
    "over_texts",
    "table",
    "text_of",
    "with_total_before",
    "written",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from
    the columns of ``frame`` (upper and lower case are the same to Spark)."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def text_of(column: str = "text") -> Column:
    """A text column in which a missing text is an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    """CRC-32 of a key written as text, modulo ``modulus``; a missing key counts as
    empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def integer(value: object, default: int = 0) -> int:
    """A number that an aggregate over no rows leaves null."""
    return default if value is None else int(value)


def with_total_before(
    frame: DataFrame, place: str, amount: str, name: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """``frame`` with the sum of ``amount`` over the rows of the same ``by`` at a smaller
    ``place``, a number that no two of them share.

    Sums within stretches of places, and sums of whole stretches: one task gets one row
    for every ``STRETCH`` places, not one for each."""
    stretch, whole, ahead, own = fresh(frame, "stretch", "whole", "ahead", "own")
    other = dict(zip(by, fresh(frame, *(f"other_{b}" for b in by)), strict=True))
    cut = frame.withColumn(stretch, F.floor(F.col(place) / STRETCH))
    earlier = Window.partitionBy(*by).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    stretches = (
        cut.groupBy(*by, stretch)
        .agg(F.sum(amount).alias(whole))
        .withColumn(ahead, F.coalesce(F.sum(whole).over(earlier), F.lit(0)))
        .select(*[F.col(b).alias(o) for b, o in other.items()], F.col(stretch).alias(own), ahead)
    )
    same = F.col(stretch) == F.col(own)
    for b, o in other.items():
        same = same & F.col(b).eqNullSafe(F.col(o))
    within = (
        Window.partitionBy(*by, stretch).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum(amount).over(within), F.lit(0)) + F.col(ahead)
    return (
        cut.join(stretches, same)
        .withColumn(name, before)
        .select(*[F.col(f"`{c}`") for c in frame.columns], name)
    )


def over_texts(
    docs: DataFrame,
    text: str,
    keep: tuple[str, ...] | None,
    fields: str,
    prepare: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    at_once: int | None = None,
) -> DataFrame:
    """A struct ``row`` of the columns to keep (all, if None) and, for each row, the
    ``fields`` computed from its text.  ``prepare`` runs once in each task and gives the
    function from a batch of texts to the arrays of the fields.  ``at_once`` texts at most are given to
    it together, where what it computes is large."""
    columns = docs.columns if keep is None else list(keep)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    inside = columns.index(text) if text in columns and dict(docs.dtypes)[text] == "string" else None
    rows = docs.select(row) if inside is not None else docs.select(row, F.col(text).cast("string"))
    names = ["row", *field_names(fields)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            size = at_once or max(batch.num_rows, 1)
            for at in range(0, max(batch.num_rows, 1), size):
                kept, *more = batch.slice(at, size).columns
                texts = more[0] if inside is None else kept.flatten()[inside]
                yield pa.RecordBatch.from_arrays([kept, *compute(texts)], names=names)

    return rows.mapInArrow(scan, f"row {rows.schema['row'].dataType.simpleString()}, {fields}")


def over_held_texts(
    docs: DataFrame,
    text: str,
    keep: tuple[str, ...] | None,
    fields: str,
    compute: Callable[[list[pa.Array]], Iterator[list[pa.Array]]],
    held_bytes: int,
) -> DataFrame:
    """As :func:`over_texts`, for work with a cost of its own beside that of the texts: ``compute`` gets the
    texts of several batches at once, up to ``held_bytes``, and gives each batch's arrays."""
    columns = docs.columns if keep is None else list(keep)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = docs.select(row, F.col(text).cast("string").alias("text"))
    names = ["row", *field_names(fields)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            for batch, own in zip(held, compute([b.column(1) for b in held]), strict=True):
                yield pa.RecordBatch.from_arrays([batch.column(0), *own], names=names)

        for batch in batches:
            held.append(batch)
            if sum(b.column(1).nbytes for b in held) >= held_bytes:
                yield from done()
                held = []
        if held:
            yield from done()

    return rows.mapInArrow(scan, f"row {rows.schema['row'].dataType.simpleString()}, {fields}")


def field_names(ddl: str) -> list[str]:
    """Names of the fields in a list like ``a int, b struct<c: int, d: int>``."""
    parts, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [part.split()[0] for part in parts]
