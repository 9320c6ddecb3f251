"""Exact search by inner product: vectors in order of length, rotated partial sums, bounds.

1. A component x becomes ``floor(SCALE * x)``, and a score is an inner product of integers.
2. The sums of XᵀX, added up over the tasks, give the right singular vectors.  In their basis the first
   components hold most of a vector's length, and the inner products stay the same.
3. Vectors are cut into classes of falling length, at most ``CLASSES`` of them by percentiles, and a class
   into equal blocks.  The ``SEED_ROWS`` longest vectors, broadcast, give each query a *floor*: its last place among
   them.  A query is sent to the blocks of those classes whose longest vector, times its own length, reaches the
   floor (Cauchy-Schwarz); these are the first ones.
4. A block is searched in one task, longest vectors first, for a chunk of queries at a time.  A partial sum over the
   first rotated components plus the product of the lengths of what is left bounds a score; pairs whose
   bound stays below the floor are dropped, the others get more components.  The search of a block ends where the length
   alone keeps all queries from their floors.  Scores of the pairs left are computed in integers, and raise the floors.
5. The best of all blocks are merged by a window.

Bounds carry a margin for rounding, and a pair at the floor is kept, so ties are settled by id.  Blocks hold about
twice the number of cores in all, within ``BLOCK_BYTES``: the queries are shuffled once for each block, and a block's vectors once.

Edge cases: vectors that are null or hold a null, NaN or infinite component, and rows without an id, take no
part; zero vectors do, and score 0; components and scores that a long can't hold become the nearest long,
before ranking; only vectors of one length are compared; a repeated row counts once; an id with several vectors
counts with its best, and as a query finds what any of them finds; fewer rows than places give them all;
no rows give no rows.  The id must be of an integer type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logitblend.llm.common import integer, written
from logitblend.llm.vectors import clamped, finite, integers, matrix, striped, summed

SCALE = 64
TOP = 20
CLASSES = 1024
SEED_ROWS = 2048
SEED_BYTES = 4 << 20
LEAST_BLOCK = 2048
BLOCK_BYTES = 32 << 20
TASKS = 20_000
CHUNK = 256
SLAB = 1024
EXACT = 2.0**53

_RESULT = "query_id long, vec_id long, score long"


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products of integer vectors, exactly, within the limits of a long."""
    with np.errstate(invalid="ignore"):
        found = (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    # No partial sum goes beyond the product of the lengths; the few that may are done again.
    a, b = np.nonzero(_lengths(queries)[:, None] * _lengths(vectors)[None, :] >= EXACT)
    found[a, b] = _wide(queries, vectors, a, b)
    return found


def paired_scores(queries: np.ndarray, vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows ``a`` with the rows ``b``."""
    found = np.einsum("ij,ij->i", queries[a], vectors[b])
    large = np.flatnonzero(_lengths(queries)[a] * _lengths(vectors)[b] >= EXACT)
    found[large] = _wide(queries, vectors, a[large], b[large])
    return found


def _wide(queries: np.ndarray, vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    return [clamped(sum(map(int.__mul__, queries[i].tolist(), vectors[j].tolist()))) for i, j in zip(a, b, strict=True)]


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of each query's ``top`` candidates: highest score, ties to the smaller id, each
    id once, with its best score."""
    order = np.lexsort((score, ids, query))[::-1]  # the best of an id comes first
    q, i = query[order], ids[order]
    first = np.ones(len(order), bool)
    first[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    order = order[first]
    order = order[np.lexsort((ids[order], ~score[order], query[order]))]
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[place < top]


class Block:
    """Vectors by falling length, rotated, with the lengths of what each stage leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray):
        length = _lengths(vectors)
        order = np.argsort(-length, kind="stable")
        self.ids, self.vectors, self.length = ids[order], vectors[order], length[order]
        self.rotation = rotation
        width = vectors.shape[1]
        self.cuts = sorted({width // 8, width // 4, width // 2, width} - ({0} if width else set()))
        self.rotated, self.rest = self._turned(self.vectors)
        self.dropped = 0  # pairs that no score was computed for

    def _turned(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        rotated = vectors @ self.rotation
        return rotated, [np.sqrt((rotated[:, c:] ** 2).sum(axis=1)) for c in self.cuts]

    def search(
        self, own: np.ndarray, queries: np.ndarray, floors: np.ndarray, top: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and score of each query's best here, if it reaches its floor."""
        length = _lengths(queries)
        turned, rest = self._turned(queries)
        floors = floors.astype(np.float64)
        margin = 1e-11 * length * (self.length[0] if len(self.length) else 0.0) + 1e-6
        q, ids, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(self.ids), SLAB):
            part = slice(at, at + SLAB)
            lower = floors - margin
            alive = np.flatnonzero(length * self.length[at] >= lower)
            if not len(alive):
                self.dropped += len(queries) * (len(self.ids) - at)
                break
            a, b = self._near(turned[alive], [r[alive] for r in rest], part, lower[alive])
            new = own[alive[a]] != self.ids[at + b]
            a, b = alive[a[new]], at + b[new]
            self.dropped += len(queries) * len(self.ids[part]) - len(a)
            if not len(a):
                continue
            if 4 * len(a) > len(alive) * SLAB:
                exact = scores(queries[alive], self.vectors[part])
                found = exact[np.searchsorted(alive, a), b - at]
            else:
                found = paired_scores(queries, self.vectors, a, b)
            q, ids, score = np.r_[q, a], np.r_[ids, self.ids[b]], np.r_[score, found]
            keep = best(q, ids, score, top)
            q, ids, score = q[keep], ids[keep], score[keep]
            full = np.bincount(q, minlength=len(queries)) == top
            last = np.flatnonzero(np.r_[q[1:] != q[:-1], True])
            last = last[full[q[last]]]
            floors[q[last]] = np.maximum(floors[q[last]], score[last])
        return q, ids, score

    def _near(
        self, turned: np.ndarray, rest: list[np.ndarray], part: slice, lower: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in the slab) whose bound reaches the query's floor."""
        slab, sums, pairs, done = self.rotated[part], 0.0, None, 0
        for stage, cut in enumerate(self.cuts):
            left, left_here = rest[stage], self.rest[stage][part]
            if pairs is None:
                sums = sums + turned[:, done:cut] @ slab[:, done:cut].T
                near = sums + left[:, None] * left_here[None, :] >= lower[:, None]
                if 10 * np.count_nonzero(near) < near.size or stage + 1 == len(self.cuts):
                    pairs = np.nonzero(near)
                    sums = sums[pairs]
            else:
                a, b = pairs
                sums = sums + np.einsum("ij,ij->i", turned[a, done:cut], slab[b, done:cut])
                near = sums + left[a] * left_here[b] >= lower[a]
                pairs, sums = (a[near], b[near]), sums[near]
            done = cut
        return pairs


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the vectors ``x``, largest first: eigenvectors of XᵀX."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            own = matrix(batch.column(0), width).astype(np.float64)
            total += own.T @ own
        yield from striped(total)

    if not width:
        return np.zeros((0, 0))
    total = summed(rows.select("x").mapInArrow(moments, "stripe int, cells binary"), width, width)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


def _floors(asked: DataFrame, rows: DataFrame, width: int, top: int) -> DataFrame:
    """``asked`` with ``floor``: the score at the last place among the longest vectors; null if
    there are too few."""
    limit = min(SEED_ROWS, max(2 * top, SEED_BYTES // (8 * max(width, 1))))
    seeds = rows.orderBy(F.desc("length"), "id", "x").limit(limit).select("id", "x").collect()
    kept = {row["id"]: row["x"] for row in reversed(seeds)}  # one vector of each id
    ids = np.array(list(kept), np.int64)
    vectors = np.array(list(kept.values()), np.int64).reshape(len(kept), width)

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                own = np.asarray(part.column("id"), np.int64)
                found = scores(matrix(part.column("x"), width), vectors)
                least = []
                for line, i in zip(found, own, strict=True):
                    line = line[ids != i]
                    least.append(int(np.partition(line, -top)[-top]) if len(line) >= top else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(least, pa.int64())], names=[*part.schema.names, "floor"]
                )

    return asked.mapInArrow(floor, "id long, x array<long>, length double, floor long")


def _classes(rows: DataFrame, n_blocks: int) -> tuple[list[float], list[float], list[int]]:
    """Limits of length between classes (falling), each class's longest vector, and the number of
    blocks up to and with it."""
    wanted = min(CLASSES, n_blocks)
    cuts: list[float] = []
    if wanted > 1:
        shares = [1 - k / wanted for k in range(1, wanted)]
        cuts = sorted({*rows.agg(F.percentile_approx("length", shares, 10 * CLASSES)).first()[0]}, reverse=True)
    counted = (
        rows.withColumn("class", _class(cuts))
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
        .collect()
    )
    n = {row["class"]: (row["n"], row["longest"]) for row in counted}
    total = sum(c for c, _ in n.values())
    longest, upto = [], []
    for k in range(len(cuts) + 1):
        count, top = n.get(k, (0, 0.0))
        parts = max(min(count, 1), round(count * n_blocks / max(total, 1)))
        longest.append(top)
        upto.append((upto[-1] if upto else 0) + parts)
    return cuts, longest, upto


def _class(cuts: list[float]) -> Column:
    """The number of limits above a length."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.lit(cuts), lambda c: c > F.col("length")))


def _of_one_length(
    spark: SparkSession, rows: DataFrame, asked: DataFrame, width: int, top: int, n_blocks: int
) -> DataFrame:
    turn = spark.sparkContext.broadcast(rotation(rows, width))
    cuts, longest, upto = _classes(rows, n_blocks)
    queries = _floors(asked, rows, width, top)
    starts = [0, *upto[:-1]]
    kind = _class(cuts)
    parts = F.element_at(F.lit([b - a for a, b in zip(starts, upto, strict=True)]), kind + 1)
    block = F.element_at(F.lit(starts), kind + 1) + F.pmod(F.xxhash64("id", "x"), parts)
    # What comes after a class is shorter, so the classes a query needs are the first ones.
    reach = [max(longest[k:]) for k in range(len(longest))]
    needed = F.size(
        F.filter(
            F.lit(reach),
            lambda r: F.col("floor").isNull()
            | (r * F.col("length") * (1 + 1e-11) + 1e-6 >= F.col("floor").cast("double")),
        )
    )
    blocks_needed = F.element_at(F.lit([0, *upto]), needed + 1)
    here = rows.select(
        block.cast("int").alias("block"), F.lit(False).alias("asks"), "id", "x", F.lit(None).cast("long").alias("floor")
    )
    there = (
        queries.withColumn("last", blocks_needed - 1)
        .filter("last >= 0")
        .select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), F.lit(True).alias("asks"), "id", "x", "floor")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, its vectors before its queries."""
        number, held, current = None, [], None
        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            asks = np.asarray(batch.column("asks").to_numpy(zero_copy_only=False))
            edge = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edge], [*edge, len(blocks)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if blocks[a] != number:
                    number, held, current = blocks[a], [], None
                ids, vectors = np.asarray(part.column("id"), np.int64), matrix(part.column("x"), width)
                if not asks[a]:
                    held.append((ids, vectors))
                    continue
                if current is None and held:
                    both = (np.concatenate(c) for c in zip(*held, strict=True))
                    current, held = Block(*both, turn.value), []
                if current is None:
                    continue
                least = part.column("floor").to_pylist()
                floors = np.array([-np.inf if f is None else float(f) for f in least])
                for at in range(0, len(ids), CHUNK):
                    chunk = slice(at, at + CHUNK)
                    q, found, score = current.search(ids[chunk], vectors[chunk], floors[chunk], top)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[chunk][q]), pa.array(found), pa.array(score)],
                        names=["query_id", "vec_id", "score"],
                    )

    tasks = min(TASKS, upto[-1])
    return (
        here.unionAll(there)
        .repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int"))
        .sortWithinPartitions("block", "asks")
        .mapInArrow(search, _RESULT)
    )


def highest(
    table: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    top: int = TOP,
    scale: int = SCALE,
    block_rows: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``queries`` selects, the other rows
    with the highest inner products, ties to the smaller id."""
    spark = table.sparkSession
    if table.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be an integer column")
    part = table.filter(F.col(key).isNotNull() & finite(vector)).select(
        F.col(key).cast("long").alias("id"),
        integers(vector, scale).alias("x"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    )
    squares = F.aggregate("x", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    # A repeated row counts once.
    rows = part.groupBy("id", "x").agg(F.max("asks").alias("asks"))
    rows = written(rows.withColumn("length", F.sqrt(squares)).withColumn("size", F.size("x")), "integers")
    found = spark.createDataFrame([], _RESULT)
    for size, n in rows.groupBy("size").agg(F.count(F.lit(1))).collect():
        most = max(LEAST_BLOCK, BLOCK_BYTES // (8 * max(size, 1)))
        spread = -(-integer(n) // (2 * spark.sparkContext.defaultParallelism))
        each = block_rows or min(most, max(LEAST_BLOCK, spread))
        own = rows.filter(F.col("size") == size)
        asked = own.filter("asks").select("id", "x", "length")
        found = found.unionAll(
            _of_one_length(spark, own.select("id", "x", "length"), asked, size, top, -(-integer(n) // each))
        )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
