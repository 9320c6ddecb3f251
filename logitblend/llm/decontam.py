"""Benchmark decontamination by Wu-Manber search over words.

The symbols of the search are words.  Every window of ten consecutive words of an item
is a pattern (an item of fewer words is one pattern).  Patterns of one length share two
tables: the *shift* of a block of two words is how far the window may slide when a document's
window ends in that block, and patterns whose last block it is (shift zero) lie in a
*bucket* under that block.  Only those are compared with the document, word for
word.  Most document windows slide by nine words at once.

Items are searched in blocks of at most ``BLOCK_BYTES`` of item text, as the tables of a block take some fifty times
its size.  The documents are scanned once all the same: a task holds ``HELD_BYTES`` of documents, and builds
and searches one block's tables after the other.  The blocks are broadcast, up to ``SCAN_BYTES`` of them; only
larger sets of items take more scans, and then a document's hits meet in an aggregate.

Edge cases: a missing text, of a document or an item, has no words; an item without an
id marks words but isn't listed; repeated items count once; without items nothing is
hit; every document row gives one result row, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logitblend.llm.common import fresh, integer, over_held_texts, over_texts

WINDOW = 10
BLOCK_BYTES = 2 << 20
SCAN_BYTES = 32 << 20
HELD_BYTES = 32 << 20

# Lower-case A to Z; every other ASCII character but digits and letters is a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class Patterns:
    """Shift table and buckets of patterns of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.most = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}

    def add(self, pattern: tuple[bytes, ...], item: int) -> None:
        for end in range(self.block, self.length + 1):
            key, shift = pattern[end - self.block : end], self.length - end
            if shift < self.shift.get(key, self.most):
                self.shift[key] = shift
        same = self.buckets.setdefault(pattern[-self.block :], {})
        same.setdefault(pattern, set()).add(item)

    def find(self, text: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """Ends of occurrences, in order, with the items they belong to."""
        length, most, n = self.length, self.most, len(text)
        at, shifts = length, self.shift
        if self.block == 1:
            while at <= n:
                same = self.buckets.get((text[at - 1],))
                if same:
                    yield from ((at, items) for items in same.values())
                at += 1
            return
        while at <= n:
            last = (text[at - 2], text[at - 1])
            step = shifts.get(last, most)
            if step:
                at += step
                continue
            items = self.buckets[last].get(tuple(text[at - length : at]))
            if items:
                yield at, items
            at += 1


def compiled(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Search tables of (number, text) items, one for each pattern length."""
    tables: dict[int, Patterns] = {}
    for number, text in items:
        own = words(text)
        length = min(window, len(own))
        if length:
            patterns = tables.setdefault(length, Patterns(length))
            for start in range(len(own) - length + 1):
                patterns.add(tuple(own[start : start + length]), number)
    return list(tables.values())


def search(tables: list[Patterns], text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, hit spans [start, end) merged, and numbers of the items found."""
    own = words(text)
    spans: list[tuple[int, int]] = []
    found: set[int] = set()
    for table in tables:
        for end, items in table.find(own):
            found |= items
            start = end - table.length
            if spans and spans[-1][0] <= start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    if len(tables) > 1:
        spans = merged(spans)
    return len(own), spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_FOUND = "words long, spans array<struct<start: int, stop: int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _searched(
    docs: DataFrame, text: str, keep: tuple[str, ...] | None, blocks: list[list[tuple]]
) -> DataFrame:
    """What some blocks of items hit, in one scan."""
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(block) for block in blocks]

    def built(block: Broadcast) -> tuple[list[Patterns], list[str | None]]:
        return compiled([(i, t) for i, (_, t) in enumerate(block.value)]), [n for n, _ in block.value]

    def arrays(rows: list[tuple[int, list, set]]) -> list[pa.Array]:
        return [
            pa.array([n for n, _, _ in rows], pa.int64()),
            pa.array([[{"start": a, "stop": b} for a, b in s] for _, s, _ in rows], _SPANS),
            pa.array([sorted(f - {None}) for _, _, f in rows], pa.list_(pa.string())),
        ]

    if len(blocks) == 1:

        def prepare():
            tables, names = built(sent[0])

            def find(texts: pa.Array) -> list[pa.Array]:
                rows = [search(tables, t) for t in texts.to_pylist()]
                return arrays([(n, s, {names[i] for i in f}) for n, s, f in rows])

            return find

        return over_texts(docs, text, keep, _FOUND, prepare)

    def find(parts: list[pa.Array]) -> Iterator[list[pa.Array]]:
        found: list[list] = [[(0, [], set()) for _ in part] for part in parts]
        for block in sent:
            tables, names = built(block)
            for rows, part in zip(found, parts, strict=True):
                for k, value in enumerate(part):
                    n, spans, items = search(tables, value.as_py())
                    rows[k] = (n, rows[k][1] + spans, rows[k][2] | {names[i] for i in items})
        for rows in found:
            yield arrays([(n, merged(s), f) for n, s, f in rows])

    return over_held_texts(docs, text, keep, _FOUND, find, HELD_BYTES)


def _union(spans: Column) -> Column:
    """Array of sorted spans with those that meet joined."""
    joined = F.aggregate(
        spans,
        F.array().cast("array<struct<start: int, stop: int>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["stop"] >= s["start"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(
                    F.struct(
                        F.element_at(out, -1)["start"].alias("start"),
                        F.greatest(F.element_at(out, -1)["stop"], s["stop"]).alias("stop"),
                    )
                ),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )
    return joined


def hits(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: tuple[str, ...] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns to keep (all, if None) in a struct ``row``; ``words``, how many the text has; ``spans``
    of word positions that are part of an item's window; ``items``, their ids as text."""
    items = items.select(
        F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")
    ).distinct()
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total = integer(items.agg(F.sum(weight)).first()[0])
    n_blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    each = max(1, SCAN_BYTES // block_bytes)

    def blocks(numbers: range) -> list[list[tuple]]:
        number = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int")
        some = items.withColumn("block", number).filter(F.col("block").between(numbers[0], numbers[-1]))
        found: dict[int, list[tuple]] = {}
        for row in some.collect():
            found.setdefault(row["block"], []).append((row["id"], row["text"]))
        return list(found.values()) or [[]]

    if n_blocks <= each:
        return _searched(docs, text, keep, blocks(range(n_blocks)))
    (number,) = fresh(docs, "number")
    columns = docs.columns if keep is None else list(keep)
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    parts = []
    for k in range(0, n_blocks, each):
        block = blocks(range(k, min(k + each, n_blocks)))
        parts.append(_searched(numbered, text, (*columns, number), block))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return (
        found.groupBy(F.col(f"row.`{number}`").alias("number"))
        .agg(
            F.struct(*[F.first(f"row.`{c}`").alias(c) for c in columns]).alias("row"),
            F.first("words").alias("words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .select("row", "words", _union(F.col("spans")).alias("spans"), "items")
    )


def contamination(found: DataFrame) -> list[Column]:
    """Result columns over ``hits``: counts, digest of the sorted item ids, verdict."""
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]).cast("long")
    return [
        F.col("words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    ]


def clean(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """The documents without any hit word, as they are."""
    return hits(docs, items, **columns).filter(F.size("spans") == 0).select("row.*")
