"""First-wins removal of repeated questions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longer keys are shuffled as a digest.
LONGEST_PLAIN_KEY = 64
#: Columns of a compact key.
KEY = ["_key_bytes", "_key"]


def compact_key(text: Column) -> list[Column]:
    """Stand-in for a question text as a grouping key: its length, with the text
    itself where short, else its SHA-256.  A rendered few-shot prompt takes
    kilobytes; shuffling it would move most of the result table."""
    size = F.octet_length(text)
    digest = F.when(size <= LONGEST_PLAIN_KEY, text).otherwise(F.sha2(text, 256))
    return [size.alias(KEY[0]), digest.alias(KEY[1])]


def order_column(rows: DataFrame, order: str | None) -> str:
    """The column that says which row comes first: the one named, else ``order`` as
    :func:`logitblend.sources.jsonl.read_results` adds it, else ``seq``."""
    if order is None:
        order = "order" if "order" in rows.columns else "seq"
    return order


def _never_null(rows: DataFrame, order: str) -> tuple[Column, Callable[[Column], Column]]:
    """The order with rows that have none behind the others: an aggregate by order would
    pass over them, and a question of theirs alone would have no first row.  It is the
    shortest that sorts so; the function makes it whole again."""

    def marked(value: Column) -> Column:
        return F.struct(value.isNull().alias("none"), value.alias("value"))

    field = rows.schema[order]
    if isinstance(field.dataType, T.IntegralType):
        return F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1)), lambda value: value
    value, whole = short_order(rows, order)
    if isinstance(field.dataType, T.StructType) and not field.nullable:
        return value, lambda value: marked(whole(value))
    return marked(value), lambda value: marked(whole(value["value"]))


def _file_field(kind: T.DataType) -> list[str]:
    """Where an order holds the name of a file, as ``sources.places.file_order`` makes it."""
    for field in kind.fields if isinstance(kind, T.StructType) else ():
        if field.name == "file" and isinstance(field.dataType, T.StringType):
            return ["file"]
        if inner := _file_field(field.dataType):
            return [field.name, *inner]
    return []


def short_order(rows: DataFrame, order: str) -> tuple[Column, Callable[[Column], Column]]:
    """The named order without what the names of all files begin with, which sorts as the order
    does, and a function that makes it whole again.  An aggregate by order sorts its rows, and the
    folder in each of them would take most of the memory.

    Names with that beginning lie together among all names, so a digit tells whether a name is
    one of them, or lies before or behind; a name from elsewhere stays whole."""
    path = _file_field(rows.schema[order].dataType)
    # The column of a scan has file:/ where this list has file:///.
    start = commonprefix(rows.inputFiles() if path else []).replace(":///", ":/")
    if not start:
        return F.col(order), lambda value: value

    def short(name: Column) -> Column:
        elsewhere = F.concat(F.when(name < start, "0").otherwise("2"), name)
        rest = F.substr(name, F.lit(len(start) + 1))
        return F.when(name.startswith(start), F.concat(F.lit("1"), rest)).otherwise(elsewhere)

    def whole(name: Column) -> Column:
        rest = F.substr(name, F.lit(2))
        return F.when(name.startswith("1"), F.concat(F.lit(start), rest)).otherwise(rest)

    def changed(value: Column, change: Callable[[Column], Column]) -> Column:
        return value.withField(".".join(path), change(reduce(Column.getField, path, value)))

    return changed(F.col(order), short), lambda value: changed(value, whole)


def first_rows(rows: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """The first whole row of each key.  The rank limit also runs before the
    shuffle, so at most one row per key and map task is moved."""
    order = order_column(rows, order)
    place = Window.partitionBy(*key).orderBy(F.col(order).asc_nulls_last())
    return (
        rows.withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def first_values(
    rows: DataFrame,
    question: str,
    values: Mapping[str, Column],
    by: Sequence[str] = (),
    order: str | None = None,
    keep_order: bool = False,
) -> DataFrame:
    """For each question text (within the ``by`` columns) the given values of its
    first row.  An aggregate with partial results per map task: a question
    holding much of the table costs no more than any other, and with
    fixed-width values it is hash-based.  ``keep_order`` keeps the question's compact key and the place of
    that row (``_order``), to go on with."""
    order = order_column(rows, order)
    place, whole = _never_null(rows, order)
    narrow = rows.select(
        *by,
        *compact_key(F.col(question)),
        place.alias("_order"),
        *[value.alias(name) for name, value in values.items()],
    )
    if isinstance(narrow.schema["_order"].dataType, T.StructType):
        # A buffer for each value would hold the order again.
        first = F.min_by(F.struct(*values), "_order").alias("_first")
        grouped = narrow.groupBy(*by, *KEY).agg(first, F.min("_order").alias("_place"))
        grouped = grouped.select("*", "_first.*", whole(F.col("_place")).alias("_order")).drop("_first", "_place")
    else:
        firsts = [F.min_by(name, "_order").alias(name) for name in values]
        grouped = narrow.groupBy(*by, *KEY).agg(*firsts, F.min("_order").alias("_order"))
    return grouped if keep_order else grouped.drop(*KEY, "_order")
