"""Whitening of vectors by Chebyshev-filtered subspace iteration.

1. A component c becomes the integer ``floor(SCALE * c)``.  The *fit list* holds each distinct vector once, so
   copies don't weigh; its size n and its sums S are exact.
2. A *pass* multiplies the covariance V of the fit list with a thin matrix Q: every task adds up XᵀXQ over its rows,
   centred as (n·x - S) / n before multiplying, and the tasks' sums are added up by stripes of rows.  V itself is
   never formed, and what reaches the driver is as thin as Q.
3. The subspace of the largest eigenvalues is found by rounds of ``DEGREE`` passes: a Chebyshev polynomial that stays
   small between zero and the smallest Ritz value, and grows above it, in its three-term recurrence; then QR, and
   Rayleigh-Ritz on the block.  ``SPARE`` further columns take part, so that the wanted
   eigenvalues are well above the smallest Ritz value.
4. The result is certified by its residuals, ‖Vq - eq‖ at most ``TOLERANCE`` times the largest eigenvalue, all computed
   by a pass; after that one more round is made, as its result costs no accuracy and the next one gains some.
5. Every row is centred, projected and divided by the square root of the eigenvalue.  The covariance of the whitened
   fit list is computed by a pass of its own, and its largest distance from the identity returned.

Edge cases: rows whose vector is null or holds a null, NaN or infinite component are left out; rows without an id and
repeated rows are rows like others; vectors of different lengths are whitened each with those of their
length; empty vectors have no components, and give no rows; a component whose eigenvalue is no more than rounding (as all are if
there is but one distinct vector) has whitened null and explained zero; a deviation that a long can't hold is the largest
long; no rows give no rows; input columns with the names of result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logitblend.llm.common import fresh, written
from logitblend.llm.vectors import clamped, finite, integers, matrix, striped, summed

SCALE = 256
COMPONENTS = 4
SPARE = 28
DEGREE = 10
TOLERANCE = 1e-13
ROUNDS = 500
SLICE = 4096
TASK_BYTES = 64 << 20
SEED = 20_240_612
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")

Pass = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Fit:
    """The distinct integer vectors ``x``, their number and their sums."""

    vectors: DataFrame
    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """(n·x - S) / n; the difference is exact."""
        return self.apart(x).astype(np.float64) / self.n

    def apart(self, x: np.ndarray) -> np.ndarray:
        largest = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
        if largest * self.n + max(map(abs, self.sums), default=0) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over the components of (n·x - S)², exactly."""
        apart = self.apart(x)
        if apart.dtype != object and apart.size and max(abs(int(apart.min())), int(apart.max())) ** 2 * x.shape[1] < 1 << 62:
            return (apart * apart).sum(axis=1).tolist()
        return [clamped(sum(int(a) * int(a) for a in row)) for row in apart.tolist()]


def fitted(x: DataFrame, width: int) -> Fit:
    """The fit list of rows ``x``."""
    vectors = written(x.distinct(), "fit")
    sums = (
        vectors.select(F.posexplode("x").alias("pos", "x"))
        .groupBy("pos")
        .agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
        .collect()
    )
    total = dict.fromkeys(range(width), 0) | {row["pos"]: int(row["s"]) for row in sums}
    n = vectors.count()
    # Every pass reads the list; no more tasks than it has work for.
    tasks = max(x.sparkSession.sparkContext.defaultParallelism, 8 * n * width // TASK_BYTES)
    return Fit(vectors.coalesce(tasks), max(n, 1), [total[k] for k in range(width)])


def _added(fit: Fit, width: int, part: Callable[[np.ndarray], np.ndarray], height: int, columns: int) -> np.ndarray:
    """The sum over slices of the fit list of a matrix computed from the centred slice."""
    plain = Fit(None, fit.n, fit.sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, columns))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                total += part(plain.centred(matrix(batch.column(0).slice(at, SLICE), width)))
        yield from striped(total)

    return summed(fit.vectors.select("x").mapInArrow(add, "stripe int, cells binary"), height, columns)


def covariance_times(fit: Fit) -> Pass:
    """The pass: the covariance of the fit list times a thin matrix."""
    width = len(fit.sums)

    def times(q: np.ndarray) -> np.ndarray:
        return _added(fit, width, lambda x: x.T @ (x @ q), width, q.shape[1]) / fit.n

    return times


def ritz(q: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz on an orthonormal block and its product: values falling, vectors, products."""
    small = q.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, product @ turn


def filtered(times: Pass, q: np.ndarray, product: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """A scaled Chebyshev polynomial of the operator applied to ``q``: at most about one in size on [0, cut], and
    one at ``top``."""
    half = middle = cut / 2
    sigma = first = half / (top - middle)
    before, now = q, (product - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        step = (times(now) - middle * now) * (2 * after / half) - sigma * after * before
        before, now, sigma = now, step, after
    return now


def leading(
    times: Pass, width: int, wanted: int, tolerance: float = TOLERANCE, degree: int = DEGREE
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit vectors, certified by residuals."""
    block = min(width, wanted + SPARE)
    start = np.eye(width) if block == width else np.random.default_rng(SEED).standard_normal((width, block))
    q = np.linalg.qr(start)[0]
    certified = False
    for _ in range(ROUNDS):
        values, q, product = ritz(q, times(q))
        top = values[0]
        off = np.sqrt(((product - q * values)[:, :wanted] ** 2).sum(axis=0)).max()
        # A full block is the whole space: its Ritz vectors are the eigenvectors.
        if certified or block == width or top <= 0 or values[-1] <= width * 1e-15 * top:
            break
        certified = off <= tolerance * top
        q = np.linalg.qr(filtered(times, q, product, values[-1], top, degree))[0]
    else:
        raise RuntimeError(f"residual {off} after {ROUNDS} rounds of {degree} passes")
    vectors = q[:, :wanted]
    # Either sign is right; this one doesn't depend on the run.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.maximum(values[:wanted], 0.0), vectors * signs


def _of_one_length(
    spark: SparkSession, rows: DataFrame, width: int, components: int, row: str, x: str
) -> DataFrame:
    fit = fitted(rows.select(F.col(x).alias("x")), width)
    wanted = min(components, width)
    values, vectors = leading(covariance_times(fit), width, wanted)
    trace = float(_added(fit, width, lambda c: (c * c).sum(axis=0)[:, None], width, 1).sum()) / fit.n
    # Beyond rounding, and so possible to divide by.
    usable = values > max(width, 8) * 1e-15 * max(values[0], 0.0)
    scale = np.where(usable, 1 / np.sqrt(np.where(usable, values, 1.0)), 0.0)
    turn = vectors * scale

    def moments(c: np.ndarray) -> np.ndarray:
        w = np.concatenate([c @ turn, np.ones((len(c), 1))], axis=1)
        return w.T @ w

    second = _added(fit, width, moments, wanted + 1, wanted + 1) / fit.n
    spread = second[:wanted, :wanted] - np.outer(second[:wanted, wanted], second[:wanted, wanted])
    error = float(np.abs(spread - np.eye(wanted))[np.ix_(usable, usable)].max(initial=0.0))
    explained = [float(v / trace) if u else 0.0 for v, u in zip(values, usable, strict=True)]
    plain = Fit(None, fit.n, fit.sums)
    fields = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    known = rows.schema[row].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                own = matrix(part.column(1), width)
                white = plain.centred(own) @ turn
                many = part.num_rows
                each = np.repeat(np.arange(many), wanted)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, wanted + 1), many), pa.int32()),
                        pa.array(np.full(many * wanted, plain.n), pa.int64()),
                        pa.array(plain.deviation(own), pa.int64()).take(pa.array(each)),
                        pa.array(white.ravel(), pa.float64(), mask=np.tile(~usable, many)),
                        pa.array(np.tile(explained, many), pa.float64()),
                        pa.array(np.full(many * wanted, error), pa.float64()),
                    ],
                    names=[row, *RESULT],
                )

    return rows.select(row, x).mapInArrow(project, f"`{row}` {known}, {fields}")


def whitened(
    table: DataFrame,
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """For every row with a usable vector and each component, from 1: the columns to keep (all, if None) and
    ``component``, ``n`` (size of the fit list), ``deviation`` (sum of (n·x - S)²), ``whitened``, ``explained`` (share of the
    variance) and ``identity_error`` (largest entry of the whitened covariance minus the identity)."""
    columns = [c for c in (table.columns if keep is None else keep) if c.lower() not in RESULT]
    row, x = fresh(table, "row", "x")
    part = table.filter(finite(vector)).select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row), integers(vector, scale).alias(x)
    )
    part = written(part.withColumn("size", F.size(x)), "integers")
    spark = table.sparkSession
    lengths = [r["size"] for r in part.select("size").distinct().collect() if r["size"]]
    found = None
    for width in sorted(lengths) or [1]:
        own = _of_one_length(spark, part.filter(F.col("size") == width), width, components, row, x)
        found = own if found is None else found.unionAll(own)
    return found.select(*[F.col(f"{row}.`{c}`").alias(c) for c in columns], *RESULT)
