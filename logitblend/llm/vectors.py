"""What the operators over whole tables of vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIPE = 64
LONG = (-(1 << 63), (1 << 63) - 1)


def finite(vector: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    every = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(every, F.lit(False))


def integers(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component as long; what a long can't hold becomes the
    nearest one."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype: type = np.int64) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype).reshape(len(column), width)


def clamped(value: int) -> int:
    return min(max(value, LONG[0]), LONG[1])


def summed(parts: DataFrame, height: int, width: int) -> np.ndarray:
    """The sum of matrices that the tasks gave as rows ``stripe, cells``, in the form of
    ``striped``.  Each stripe of rows is added up in one task, so what reaches
    the driver is one matrix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(cells.as_buffer(), np.float64)
                totals[stripe] = totals[stripe] + own if stripe in totals else own
        yield from _stripes(totals)

    whole = np.zeros((height, width))
    n = -(-height // STRIPE)
    met = parts.repartition(1) if n <= 1 else parts.repartition(n, "stripe")
    for stripe, cells in met.mapInArrow(add, "stripe int, cells binary").collect():
        at = stripe * STRIPE
        whole[at : at + STRIPE] = np.frombuffer(bytes(cells), np.float64).reshape(-1, width)
    return whole


def striped(whole: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A matrix as rows ``stripe, cells`` of ``STRIPE`` of its rows each."""
    whole = np.ascontiguousarray(whole, np.float64)
    yield from _stripes({at // STRIPE: whole[at : at + STRIPE] for at in range(0, len(whole), STRIPE)})


def _stripes(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for stripe, cells in parts.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([stripe], pa.int32()), pa.array([cells.tobytes()], pa.binary())],
            names=["stripe", "cells"],
        )
