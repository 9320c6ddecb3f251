"""Approximate nearest neighbours by robustly pruned directed graphs, one for each shard.

Equal vectors become one point with the smallest of their ids, as many as a result can hold,
first inside each task and again in the shard.  Points are dealt by the hash of their vector into shards
of about ``SHARD_ROWS`` rows.  Each shard's graph starts with random edges; then each
point is searched for in the graph so far, the points met on the way are its candidates, and the
robust rule keeps the nearest and drops every candidate that is ``ALPHA`` times nearer to
one that was kept.  Edges are added the other way, too, and pruned again beyond ``DEGREE``.
Points go in by batches, so a step of all searches of a batch is one numpy operation.

Each shard is built in a task of its own, and written to the shared folder.  A query is sent to every shard, where
queries stream past its graph, ``QUERY_ROWS`` beam searches at a time.

Distances are in double precision.  Vectors whose largest entries are 2^``CLASS`` apart don't share a shard, and where
squares would leave the range of doubles, a shard's points, or a query and the points it meets, are scaled by a power of two; so a
vector far away spoils no search among others.

Edge cases: vectors that are null, empty or zero, or hold a null, NaN or infinite component,
and rows without an id, take no part; vectors of another length are never compared; a repeated
row counts once; an id with several vectors counts with the nearest, and as a query finds what any of
its vectors finds; a shard of no more points than a search holds is compared as a whole, so fewer rows than
neighbours give them all; a distance that a double can't hold is infinite; no rows give no rows.  The id must
be of an integer type.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logitblend.llm.common import integer, written

NEAREST = 10
SHARD_ROWS = 5000
QUERY_ROWS = 256
TASKS = 20_000
CLASS = 400
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 48
SEARCH_BEAM = 100
BATCH = 256
SEED = 20_240_606


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _exponents(rows: np.ndarray) -> np.ndarray:
    """Of each row the power of two that none of its entries reaches."""
    return np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1]


def distances(points: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances, also where squares would be too large or too small for doubles."""
    with np.errstate(over="ignore"):
        apart = points - vector
        power = _exponents(apart)
        far = np.sqrt((apart**2).sum(axis=1))
        odd = np.flatnonzero((power > 500) | (power < -480))
        scaled = np.sqrt((np.ldexp(apart[odd], -power[odd, None]) ** 2).sum(axis=1))
        far[odd] = np.ldexp(scaled, power[odd])
    far[np.isinf(apart).any(axis=1)] = np.inf
    return far


class Graph:
    """Points, scaled by 2^``power``, and their out-edges; -1 where a point has fewer."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, start: int, power: int = 0):
        self.points, self.edges, self.start, self.power = points, edges, start, power

    @classmethod
    def built(cls, points: np.ndarray, seed: int = SEED) -> Graph:
        r = np.random.default_rng(seed)
        n = len(points)
        edges = np.full((n, DEGREE), -1, np.int32)
        few = min(DEGREE // 2, n - 1)
        if few:
            jumps = r.integers(1, n, (n, few))
            edges[:, :few] = (np.arange(n)[:, None] + jumps) % n
        top = int(_exponents(points).max())
        power = -top if top > 400 or top < -400 else 0
        points = np.ldexp(points, power)
        centre = points.mean(axis=0)
        graph = cls(points, edges, int(((points - centre) ** 2).sum(axis=1).argmin()), power)
        order = r.permutation(n)
        for at in range(0, n, BATCH):
            graph.insert(order[at : at + BATCH])
        return graph

    def find(self, vectors: np.ndarray, beam: int) -> np.ndarray:
        """The points met for each vector, nearest first; -1 where fewer were met."""
        far = np.maximum(_exponents(vectors) + self.power - 500, 0)
        queries = np.ldexp(vectors, (self.power - far)[:, None])
        return self.search(queries, beam, np.ldexp(1.0, -far) if far.any() else None)[0]

    def search(
        self, queries: np.ndarray, beam: int, shrink: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The best points met for each query, nearest first, with squared distances;
        -1 and infinity where fewer were met.  Points are taken times ``shrink``, if given."""

        def apart(found: np.ndarray, query: np.ndarray) -> np.ndarray:
            points = self.points[found]
            return (points if shrink is None else points * shrink[query, None]) - queries[query]

        n, q = len(self.points), len(queries)
        rows = np.arange(q)
        ids = np.full((q, beam), -1, np.int32)
        far = np.full((q, beam), np.inf)
        if n <= beam:
            diff = apart(np.tile(np.arange(n), q), np.repeat(rows, n))
            every = np.einsum("ij,ij->i", diff, diff).reshape(q, n)
            ids[:, :n] = np.argsort(every, axis=1, kind="stable")
            far[:, :n] = np.take_along_axis(every, ids[:, :n].astype(np.int64), axis=1)
            return ids, far
        met = np.zeros((q, n), bool)
        done = np.ones((q, beam), bool)
        ids[:, 0], done[:, 0], met[:, self.start] = self.start, False, True
        far[:, 0] = (apart(np.full(q, self.start), rows) ** 2).sum(axis=1)
        while True:
            active = rows[~done.all(axis=1)]
            if not len(active):
                return ids, far
            place = done[active].argmin(axis=1)  # the nearest one not yet expanded
            done[active, place] = True
            near = self.edges[ids[active, place]]
            new = (near >= 0) & ~met[active[:, None], near]
            a, b = np.nonzero(new)
            if not len(a):
                continue
            found = near[a, b]
            keep = np.unique(a.astype(np.int64) * n + found, return_index=True)[1]
            a, b, found = a[keep], b[keep], found[keep]
            met[active[a], found] = True
            d = np.full(near.shape, np.inf)
            diff = apart(found, active[a])
            d[a, b] = np.einsum("ij,ij->i", diff, diff)
            both = np.concatenate([far[active], d], axis=1)
            best = np.argsort(both, axis=1, kind="stable")[:, :beam]
            line = np.arange(len(active))[:, None]
            far[active] = both[line, best]
            ids[active] = np.where(
                np.isfinite(far[active]), np.concatenate([ids[active], near], axis=1)[line, best], -1
            )
            fresh = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)[line, best]
            done[active] = fresh | (ids[active] < 0)

    def insert(self, batch: np.ndarray) -> None:
        """Edges of a batch of points from searches for them, and edges back to them."""
        found, _ = self.search(self.points[batch], BUILD_BEAM)
        candidates = np.concatenate([found, self.edges[batch]], axis=1)
        self.edges[batch] = self.pruned(batch, candidates)
        source = np.repeat(batch, DEGREE)
        target = self.edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, counts = np.unique(target, return_index=True, return_counts=True)
        for width in np.unique(counts):
            own = heads[counts == width]
            more = source[first[counts == width][:, None] + np.arange(width)]
            known = (self.edges[own][:, :, None] == more[:, None, :]).any(axis=1)
            more = np.where(known, -1, more)
            room = (self.edges[own] < 0).sum(axis=1)
            fits = room >= (more >= 0).sum(axis=1)
            for head, ids in zip(own[fits], more[fits], strict=True):
                ids = ids[ids >= 0]
                free = np.flatnonzero(self.edges[head] < 0)[: len(ids)]
                self.edges[head, free] = ids
            full = own[~fits]
            for at in range(0, len(full), BATCH):
                part = full[at : at + BATCH]
                lists = np.concatenate([self.edges[part], more[~fits][at : at + BATCH]], axis=1)
                self.edges[part] = self.pruned(part, lists)

    def pruned(self, owners: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Up to ``DEGREE`` of each owner's candidates, by the robust rule."""
        ids = np.where(candidates == owners[:, None], -1, candidates)
        ids = -np.sort(-ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        vectors = self.points[ids]
        diff = vectors - self.points[owners][:, None]
        far = np.einsum("ijk,ijk->ij", diff, diff)
        far[ids < 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        line = np.arange(len(owners))[:, None]
        ids, far, vectors = ids[line, order], far[line, order], vectors[line, order]
        norms = np.einsum("ijk,ijk->ij", vectors, vectors)
        between = norms[:, :, None] + norms[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1))
        alive = np.isfinite(far)
        out = np.full((len(owners), DEGREE), -1, np.int32)
        rows = np.arange(len(owners))
        for k in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            best = alive.argmax(axis=1)
            out[some, k] = ids[rows, best][some]
            alive[rows, best] = False
            alive &= ALPHA * ALPHA * between[rows, best] > far
        return out


def _packed(**arrays: np.ndarray) -> bytes:
    data = io.BytesIO()
    np.savez(data, **arrays)
    return data.getvalue()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _distinct(ids: np.ndarray, vectors: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct vectors of one length, and rows (number of the vector, id): each vector's
    ``limit`` smallest ids."""
    whole = np.ascontiguousarray(vectors).view([("", np.void, 8 * vectors.shape[1])]).ravel()
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    order = np.lexsort((ids, number))
    number, own = number[order], ids[order]
    new = np.r_[True, (number[1:] != number[:-1]) | (own[1:] != own[:-1])]
    number, own = number[new], own[new]
    starts = np.searchsorted(number, np.arange(len(first)))
    inside = np.arange(len(number)) - starts[number] < limit
    return vectors[first], number[inside], own[inside]


def _least_ids(limit: int):
    """Rows of a task, with at most ``limit`` ids for each vector: the smallest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("vector").value_lengths())
            ids = np.asarray(batch.column("id"))
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                vectors = _matrix(batch.column("vector").take(pa.array(own)))
                points, number, kept = _distinct(ids[own], vectors, limit)
                flat = pa.array(points[number].ravel())
                ends = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept), pa.ListArray.from_arrays(ends, flat)], names=["id", "vector"]
                )

    return scan


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows sorted by ``key``, cut where it changes."""
    for batch in batches:
        columns = [np.asarray(batch.column(c)) for c in key]
        edges = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in columns:
            edges |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(edges) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _class() -> Column:
    """Number of the range that a vector's largest entry is in."""
    top = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    return F.floor((F.log2(top) + CLASS / 2) / CLASS).cast("int")


def graphs(rows: DataFrame, shards: int, nearest: int = NEAREST) -> DataFrame:
    """Of rows ``id, vector``: ``size`` (of the vectors), ``shard`` and ``graph``."""

    def built(key: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([np.asarray(p.column("id")) for p in parts])
        vectors = np.concatenate([_matrix(p.column("vector")) for p in parts])
        points, number, own = _distinct(ids, vectors, nearest + 1)
        graph = Graph.built(points)
        data = _packed(
            points=points, number=number, ids=own, edges=graph.edges, start=np.array([graph.start, graph.power])
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([data], pa.binary())],
            names=["size", "shard", "graph"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for key, part in _groups(batches, ("size", "shard")):
            if held and key != last:
                yield built(last, held)
                held = []
            last = key
            held.append(part)
        if held:
            yield built(last, held)

    few = rows.mapInArrow(_least_ids(nearest + 1), "id long, vector array<double>")
    dealt = few.withColumn("size", F.size("vector")).withColumn(
        "shard", _class() * shards + F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")
    )
    tasks = min(TASKS, shards)
    return (
        dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
        .sortWithinPartitions("size", "shard")
        .mapInArrow(build, "size int, shard int, graph binary")
    )


class _Shard:
    """A graph with the ids of its points."""

    def __init__(self, data: bytes):
        kept = np.load(io.BytesIO(data))
        self.points, self.number, self.ids = kept["points"], kept["number"], kept["ids"]
        start, power = kept["start"].tolist()
        self.graph = Graph(np.ldexp(self.points, power), kept["edges"], start, power)
        self.starts = np.searchsorted(self.number, np.arange(len(self.points) + 1))

    def nearest(self, query: int, vector: np.ndarray, found: np.ndarray, nearest: int) -> list[tuple[int, int, float]]:
        far = distances(self.points[found], vector)
        counts = self.starts[found + 1] - self.starts[found]
        at = np.repeat(self.starts[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        ids, far = self.ids[at], np.repeat(far, counts)
        ids, far = ids[ids != query], far[ids != query]
        order = np.lexsort((ids, far))[:nearest]
        return [(query, i, d) for i, d in zip(ids[order].tolist(), far[order].tolist(), strict=True)]


def neighbours(
    table: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``queries`` selects, the nearest
    other rows found, by Euclidean distance, ties to the smaller id."""
    if table.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be an integer column")
    part = table.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    columns = (
        F.col(key).cast("long").alias("id"),
        # There is one zero.
        F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("vector"),
    )
    rows, asked = part.select(*columns), part.filter(queries).select(*columns)
    shards = max(1, -(-integer(rows.count()) // shard_rows))
    index = written(graphs(rows, shards, nearest), "graphs")
    classes = [r["class"] for r in index.select(F.floor(F.col("shard") / shards).cast("int").alias("class")).distinct().collect()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, its graph before its queries."""
        last, own = None, None
        for group, part in _groups(batches, ("size", "shard")):
            if group != last:
                last, own = group, None
            asks = np.asarray(part.column("asks").to_numpy(zero_copy_only=False))
            if not asks[0]:
                own = _Shard(part.column("graph")[0].as_py())
                part = part.slice(1)
            if own is None or not part.num_rows:
                continue
            for at in range(0, part.num_rows, query_rows):
                some = part.slice(at, query_rows)
                ids, vectors = some.column("id").to_pylist(), _matrix(some.column("vector"))
                out: list[tuple[int, int, float]] = []
                for q, v, near in zip(ids, vectors, own.graph.find(vectors, max(beam, nearest + 1)), strict=True):
                    out += own.nearest(q, v, near[near >= 0].astype(np.int64), nearest)
                types = (pa.int64(), pa.int64(), pa.float64())
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["query_id", "vec_id", "score"],
                )

    graph = index.select(
        "size", "shard", F.lit(False).alias("asks"), "graph", F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("array<double>").alias("vector"),
    )
    wanted = asked.select(
        F.size("vector").alias("size"),
        F.explode(
            F.flatten(F.array(*[F.sequence(F.lit(c * shards), F.lit((c + 1) * shards - 1)) for c in classes or [0]]))
        ).alias("shard"),
        F.lit(True).alias("asks"),
        F.lit(None).cast("binary").alias("graph"),
        "id",
        "vector",
    )
    tasks = min(TASKS, shards)
    found = (
        graph.unionAll(wanted)
        .repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
        .sortWithinPartitions("size", "shard", "asks")
        .mapInArrow(search, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
