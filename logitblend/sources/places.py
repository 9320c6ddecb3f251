"""Places of rows in the files of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_order() -> Column:
    """Sorts rows of a scan as they lie in their files, in order of file name.
    Ids grow along a split, and splits are told apart by where they start.

    Filters set above a numbered scan cannot move below it; the readers take
    theirs as ``where``, so that folders are still pruned."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


def with_places(rows: DataFrame, at: str, by_file: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``place``, from 0: their number in the whole scan (or in their file, or among those that
    agree in ``by``), by the ``file_order`` in column ``at``.

    No task numbers more than a split.  Splits are counted, their counts added up, which takes
    one row for each split, and a row's id gives its place in the split."""
    names = [f"_{c}" for c in by]
    split = [F.col(f"{at}.file").alias("_file"), F.col(f"{at}.start").alias("_start")]
    counted = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], *split).agg(
        F.count(F.lit(1)).alias("_n"), F.min(f"{at}.row").alias("_first")
    )
    group = [*names, "_file"] if by_file else names
    earlier = Window.partitionBy(*group).orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("_ahead", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = (F.col(f"{at}.file") == F.col("_file")) & (F.col(f"{at}.start") == F.col("_start"))
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    place = F.col("_ahead") + F.col(f"{at}.row") - F.col("_first")
    return rows.join(offsets, same).select(*rows.columns, place.alias("place"))
