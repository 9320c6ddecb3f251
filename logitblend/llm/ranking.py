"""Ranked lexical search: item weights times document impacts, as products of dense tiles.

1. Items are taken in blocks of at most ``BLOCK_BYTES`` of text, in practice one. A block's distinct terms are its
   *vocabulary*, which is broadcast.
2. One scan of the documents counts each text's terms, and keeps the counts of those in the
   vocabulary; the result is written.  From it come N, L and the document frequencies, by aggregates of Spark, and
   with them the weight of every term.
3. A task turns the counts of ``TILE_DOCS`` documents into impacts, integers below 10^6, and multiplies them, for
   ``TILE_ITEMS`` items at a time, with the items' weights: dense tiles of float64 over the terms that
   both sides have.  A tile has so few terms that no partial sum reaches 2^53, so the products
   are exact in any order; tiles are added up as 64-bit integers.
4. A tile's candidates are merged with the task's best so far by (score, smaller id): nothing that ties with the last place
   is lost before ids decide.  Tasks' best are ranked by a window, at most ``top`` rows of each task and item.

Edge cases: a missing text has no terms; documents without a term don't count in N; items without a term, or
whose terms no document has, give no rows; items that agree in id and text are one, items of one
id with different texts are ranked each on its own; documents that share an id are documents of
their own; a missing id comes last among ties; empty tables give no rows; a very long text is cut into pieces of
``PIECE`` bytes between words, and counted as one.  The id must be of an integer type.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logitblend.llm.common import integer, over_texts, written

TOP = 10
BLOCK_BYTES = 4 << 20
TILE_DOCS = 512
TILE_ITEMS = 256
TILE_TERMS = 2048
PIECE = 1 << 20
EXACT = 1 << 53
IMPACT = 1_000_000  # no impact reaches it

# Lower-case A to Z; every other ASCII character but digits and letters is a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of bounded size."""
    folded = text.encode("utf-8", "replace").translate(_FOLD) if text else b""
    at = 0
    while at < len(folded):
        end = at + PIECE
        if end < len(folded):
            cut = folded.rfind(b" ", at, end)
            if cut < 0:  # a term longer than a piece
                cut = folded.find(b" ", end)
            end = cut if cut >= 0 else len(folded)
        yield folded[at:end].split()
        at = end + 1


def counted(text: str | None, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms a text has; numbers and counts of those in the vocabulary."""
    n, parts = 0, []
    for piece in terms(text):
        n += len(piece)
        own = np.fromiter((i for i in map(vocabulary.get, piece) if i is not None), np.int32)
        parts.append(np.unique(own, return_counts=True))
    if len(parts) == 1:
        return n, *parts[0]
    if not parts:
        return 0, np.empty(0, np.int32), np.empty(0, np.int64)
    every, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return n, every, np.bincount(place, np.concatenate([c for _, c in parts]), len(every)).astype(np.int64)


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(tf: np.ndarray, damping: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * damping)


@dataclass(frozen=True)
class Items:
    """Weights of the terms of some items: rows of (item, term), sorted, and the terms' weights."""

    n: int
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def tiles(self, size: int) -> list[tuple[int, Items]]:
        """Tiles of ``size`` items with the place of the first, terms still numbered as in the block."""
        out = []
        for at in range(0, self.n, size):
            a, b = np.searchsorted(self.item, [at, at + size])
            own = Items(min(size, self.n - at), self.item[a:b] - at, self.term[a:b], self.weight[a:b])
            out.append((at, own))
        return out

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Score of every item (row) for every document of a tile, given as rows (document, term, impact)."""
        total = np.zeros((self.n, n_docs), np.int64)
        # Terms that both sides have; the others add nothing.
        shared = np.intersect1d(self.term, term)
        own, theirs = np.isin(self.term, shared), np.isin(term, shared)
        item, weights = self.item[own], self.weight[own]
        column, row = np.searchsorted(shared, self.term[own]), np.searchsorted(shared, term[theirs])
        doc, impact = doc[theirs], impact[theirs]
        most = max(int(weights.max(initial=0)), 1) * IMPACT
        width = max(1, min(TILE_TERMS, (EXACT - 1) // most))
        for at in range(0, len(shared), width):
            here, there = (column >= at) & (column < at + width), (row >= at) & (row < at + width)
            left = np.zeros((self.n, min(width, len(shared) - at)))
            left[item[here], column[here] - at] = weights[here]
            right = np.zeros((left.shape[1], n_docs))
            right[row[there] - at, doc[there]] = impact[there]
            total += (left @ right).astype(np.int64)
        return total


class Best:
    """The best documents of each item of a tile so far, by score, then by id, a missing id last."""

    def __init__(self, n: int, top: int):
        self.top, self.last = top, np.zeros(n, np.int64)
        self.item = self.id = self.score = np.empty(0, np.int64)
        self.unnamed = np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        # What ties with the last place may still have the smaller id.
        item, doc = np.nonzero((scores > 0) & (scores >= self.last[:, None]))
        item = np.r_[self.item, item]
        score = np.r_[self.score, scores[item[len(self.item) :], doc]]
        own, none = np.r_[self.id, ids[doc]], np.r_[self.unnamed, unnamed[doc]]
        order = np.lexsort((own, none, -score, item))
        starts = np.searchsorted(item[order], np.arange(len(self.last)))
        place = np.arange(len(order)) - starts[item[order]]
        order = order[place < self.top]
        self.item, self.id, self.score, self.unnamed = item[order], own[order], score[order], none[order]
        full = np.bincount(self.item, minlength=len(self.last)) == self.top
        ends = np.searchsorted(self.item, np.arange(len(self.last)), "right") - 1
        self.last[full] = self.score[ends[full]]


def _counts(docs: DataFrame, key: str, text: str, vocabulary: Broadcast) -> DataFrame:
    """``id, n, term, tf`` of the documents with a term."""

    def prepare():
        known = vocabulary.value

        def count(texts: pa.Array) -> list[pa.Array]:
            n, term, tf = [], [], []
            for text in texts:
                own = counted(text.as_py(), known)
                n.append(own[0])
                term.append(own[1])
                tf.append(own[2])
            return [
                pa.array(n, pa.int64()),
                pa.array(term, pa.list_(pa.int32())),
                pa.array(tf, pa.list_(pa.int64())),
            ]

        return count

    rows = over_texts(docs, text, (key,), "n long, term array<int>, tf array<bigint>", prepare)
    return rows.filter("n > 0").select(F.col(f"row.`{key}`").cast("long").alias("id"), "n", "term", "tf")


def _ranked(counts: DataFrame, items: Broadcast, documents: int, length: int, top: int) -> DataFrame:
    """``item, id, score``: each task's best."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [(at, own, Best(own.n, top)) for at, own in items.value.tiles(TILE_ITEMS)]
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(start, TILE_DOCS)
                unnamed = np.asarray(part.column("id").is_null())
                ids = np.asarray(part.column("id").fill_null(0))
                damping = [10 + 90 * n * documents // length for n in part.column("n").to_pylist()]
                many = np.asarray(part.column("term").value_lengths())
                doc = np.repeat(np.arange(part.num_rows), many)
                term = np.asarray(part.column("term").flatten())
                tf = np.asarray(part.column("tf").flatten())
                impact = impacts(tf, np.array(damping, np.int64)[doc])
                for _, own, best in tiles:
                    best.add(own.scores(doc, term, impact, part.num_rows), ids, unnamed)
        for at, _, best in tiles:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(best.item + at, pa.int32()),
                    pa.array(best.id, pa.int64(), mask=best.unnamed),
                    pa.array(best.score, pa.int64()),
                ],
                names=["item", "id", "score"],
            )

    return counts.mapInArrow(score, "item int, id long, score long")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the documents with the highest scores above 0 for every item."""
    spark = docs.sparkSession
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be an integer column")
    kind = items.schema[item_id].dataType
    items = items.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total = integer(items.agg(F.sum(size)).first()[0])
    n_blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    found = None
    for k in range(n_blocks):
        mine = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).collect()
        sets = [{t for piece in terms(row["text"]) for t in piece} for row in mine]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
        counts = written(_counts(docs, key, text, spark.sparkContext.broadcast(vocabulary)), "counts")
        whole = counts.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
        documents, length = whole["N"], integer(whole["L"], 1)
        frequency = counts.select(F.explode("term").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(vocabulary) + 1, np.int64)
        for row in frequency:
            weights[row["term"]] = weight(documents, row["count"])
        pairs = np.array([(i, vocabulary[t]) for i, s in enumerate(sets) for t in s], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        block = Items(len(mine), pairs[:, 0], pairs[:, 1], weights[pairs[:, 1]])
        names = spark.createDataFrame(
            [(i, row["id"]) for i, row in enumerate(mine)], f"number int, item_id {kind.simpleString()}"
        )
        best = _ranked(counts, spark.sparkContext.broadcast(block), documents, length, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        own = (
            best.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= top)
            .join(F.broadcast(names), F.col("item") == F.col("number"))
            .select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        )
        found = own if found is None else found.unionAll(own)
    return found
