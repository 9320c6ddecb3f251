"""Results of several workers put together: columns that were logged apart, and rows in the
order of the questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logitblend.operators.dedup import KEY, compact_key
from logitblend.sources.places import with_places


def zipped(tables: Sequence[DataFrame], at: str = "seq") -> DataFrame:
    """Rows side by side by their places in the files (column ``at``, as the readers add it), as long as the
    shortest table, with that place in ``place``.

    Columns must differ in name, but for ``at``, which is dropped.  Each table is numbered by its splits,
    and the tables meet by number: no task sees a whole one."""
    result = None
    for table in tables:
        own = with_places(table, at).drop(at)
        result = own if result is None else result.join(own, "place")
    return result.select("place", *[c for c in result.columns if c != "place"])


def gathered(
    rows: DataFrame,
    worker: str,
    workers: int,
    batch: int = 1,
    question: str = "question",
    total: int | None = None,
    at: str = "seq",
) -> DataFrame:
    """Rows of ``workers`` workers (numbered from 0 in column ``worker``, each with its own files, in the order
    it logged them) in the order of the questions, in ``seq``.

    Batches of questions are dealt to workers in turn, so the n-th row of a worker has a known place.
    When there are no batches left for some workers, these are given the first questions once more; rows
    from ``total`` on are such repeats, and left out.  Without ``total``, the rows at the end are repeats if
    their questions all occurred before: a list that ends in real repeats needs it."""
    placed = with_places(rows, at, by=(worker,))
    own = F.col("place")
    turn = F.expr(f"place div {batch}") * workers + F.col(worker).cast("bigint")
    ordered = placed.withColumn("_index", turn * batch + own % batch).drop("place", at)
    if total is None:
        firsts = ordered.select(*compact_key(F.col(question)), "_index").groupBy(*KEY).agg(F.min("_index").alias("_first"))
        last = firsts.agg(F.max("_first").alias("_last"))
        kept = ordered.join(F.broadcast(last), F.col("_index") <= F.col("_last"))
        kept = kept.drop("_last")
    else:
        kept = ordered.filter(F.col("_index") < total)
    return kept.withColumnRenamed("_index", "seq")


def worker_of_file(names: str = r"([0-9]+)") -> Column:
    """Number of the worker from the last folder of a file's path."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return F.regexp_extract(folder, names, 1).cast("int")
