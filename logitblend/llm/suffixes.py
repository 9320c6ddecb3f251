"""Suffix-array dedup: bytes of strings that occur earlier, too.

``windows`` brings together the segments of text that may share strings of ``LENGTH``
bytes.  Over each block of them, this module builds an enhanced suffix array (suffixes in order,
and the prefix lengths that neighbours share) and scans it with a stack: each
common-prefix interval, a string and all its occurrences, is closed after the intervals within it.  A
string whose occurrences differ in the byte before is a maximal repeat; other
strings are part of one.  Every occurrence of a maximal repeat but the first is
removed.  An occurrence is given up at the deepest interval in which it isn't the first,
so the scan takes linear time though all occurrences count, not just neighbours.

Edge cases: a missing text is empty; a row without a key keeps all bytes, and no row is
earlier or later than it; rows with one key count as one document, with equal places where
their texts start; bytes are removed without regard to characters; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logitblend.llm.windows import (
    BLOCK,
    BYTE_HASHES,
    Bytes,
    SPANS_TYPE,
    rolling,
    without_repeats,
)
from logitblend.llm.substring import remaining

LENGTH = 100
GRAM = 24
NONE = np.empty(0, np.int64)

FIELDS = "bytes long, removed long, spans array<struct<start: int, stop: int>>, kept binary"


@dataclass(slots=True)
class Interval:
    """Suffixes ``low`` to ``high`` share ``length`` symbols.  ``left`` is the symbol before all
    of them, None if they differ; ``firsts`` are those that start first, at
    ``key``; ``later`` those that are no longer first, in this interval."""

    length: int
    low: int
    left: int | None
    key: int
    firsts: list[int]
    high: int = -1
    later: list[int] = field(default_factory=list)

    def take(self, part: Interval) -> None:
        if part.left != self.left:
            self.left = None
        if part.key < self.key:
            self.later += self.firsts
            self.key, self.firsts = part.key, part.firsts
        elif part.key > self.key:
            self.later += part.firsts
        else:
            self.firsts = self.firsts + part.firsts


def intervals(shared: list[int], left: list[int], keys: list[int], least: int) -> Iterator[Interval]:
    """Common-prefix intervals of suffixes in order, at least ``least`` symbols long, each
    after those within it.  ``shared[i]`` is what suffix i shares with i - 1."""
    stack: list[Interval] = []
    n = len(keys)
    for i in range(n):
        part = Interval(-1, i, left[i], keys[i], [i])
        ahead = shared[i + 1] if i + 1 < n else 0
        while stack and stack[-1].length > ahead:
            top = stack.pop()
            top.take(part)
            top.high = i
            yield top
            part = Interval(-1, top.low, top.left, top.key, top.firsts)
        if ahead >= least:
            if stack and stack[-1].length == ahead:
                stack[-1].take(part)
            else:
                stack.append(Interval(ahead, part.low, part.left, part.key, part.firsts))


def maximal_repeats(
    shared: list[int], left: list[int], keys: list[int], least: int
) -> Iterator[Interval]:
    """The intervals whose suffixes differ in the symbol before: maximal repeats."""
    return (x for x in intervals(shared, left, keys, least) if x.left is None)


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def starts_of_repeats(whole: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Places of strings of ``length`` bytes that occur several times, with different bytes
    before (the beginning of a segment differs from all).  A repeat that is always
    preceded by one byte is part of a longer one."""
    place = np.arange(len(whole)) - np.repeat(begins, sizes)
    at = np.flatnonzero(place + length <= np.repeat(sizes, sizes))
    hashes = rolling(BYTE_HASHES[whole], length)[at]
    order = np.argsort(hashes)
    at, hashes = at[order], hashes[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]]
    alone = new & np.r_[new[1:], True]
    at, new = at[~alone], new[~alone]
    if not len(at):
        return at
    left = np.where(place[at] == 0, -1 - at, whole[at - 1])
    first = np.flatnonzero(new)
    differ = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
    return at[np.repeat(differ, np.diff(np.r_[first, len(at)]))]


@dataclass(frozen=True)
class Group:
    """A maximal repeat: its length, all of its occurrences (segments and places in them), and which of these
    are later than another one.  Those that are so in a longer repeat already are marked there alone."""

    length: int
    segments: np.ndarray
    places: np.ndarray
    later: list[int]


def groups(
    data: list[bytes], keys: np.ndarray, length: int = LENGTH, again: np.ndarray = NONE, behind: np.ndarray = NONE
) -> Iterator[Group]:
    """The maximal repeats of ``length`` bytes at least, with all their occurrences; ``keys`` order the segments'
    beginnings.  The suffix array has only suffixes at which a maximal repeat may start.

    The segments ``again`` occur a second time, with keys ``behind``, as segments with the numbers that follow those of ``data``.
    The same strings occur in both, after the same bytes but at their beginning, where a repeat may start in any case."""
    whole = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    sizes = np.array([len(d) for d in data])
    begins = np.cumsum(sizes) - sizes
    at = np.union1d(starts_of_repeats(whole, begins, sizes, length), begins[again])
    segment = np.searchsorted(begins, at, side="right") - 1
    place = at - begins[segment]
    second = np.full(len(data), -1, np.int64)
    second[again] = len(data) + np.arange(len(again))
    twice = np.flatnonzero(second[segment] >= 0)
    suffixes = [data[k][p:] for k, p in zip(segment.tolist(), place.tolist(), strict=True)]
    suffixes += [suffixes[i] for i in twice.tolist()]
    at, place = np.r_[at, at[twice]], np.r_[place, place[twice]]
    segment = np.r_[segment, second[segment[twice]]]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    shared = np.array(
        [0, *(shared_prefix(suffixes[i], suffixes[j]) for i, j in zip(order, order[1:], strict=False))]
    )
    shared[shared < length] = 0
    # Suffixes that share `length` bytes with a neighbour, in groups.
    counts = np.diff(np.r_[np.flatnonzero(shared == 0), len(shared)])
    inside = np.repeat(counts > 1, counts)
    order, shared = np.array(order, np.int64)[inside[: len(order)]], shared[inside]
    if not len(order):
        return
    segment, place = segment[order], place[order]
    left = np.where(place == 0, -1 - segment, whole[at[order] - 1])
    own_keys = np.r_[keys, behind][segment] + place
    edges = np.r_[np.flatnonzero(shared == 0), len(order)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        lists = (x[a:b].tolist() for x in (shared, left, own_keys))
        for repeat in maximal_repeats(*lists, length):
            inside = slice(a + repeat.low, a + repeat.high + 1)
            yield Group(repeat.length, segment[inside], place[inside], [i - repeat.low for i in repeat.later])


def repeated_bytes(
    data: list[bytes], docs: np.ndarray, starts: np.ndarray, copied: np.ndarray, length: int = LENGTH
) -> Iterator[tuple[int, bool, int, int]]:
    """(segment, for its copies or itself, from, to): bytes of maximal repeats, at all places but the first.

    A segment with copies is there twice, the second time behind all others."""
    n, again = len(data), np.flatnonzero(copied)
    doc_rank = np.unique(docs, return_inverse=True)[1].astype(np.int64)
    keys = (doc_rank << 32) + starts
    behind = (doc_rank.max(initial=0) + 1 + np.arange(len(again))) << 32
    for group in groups(data, keys, length, again, behind):
        for k, p in zip(group.segments[group.later].tolist(), group.places[group.later].tolist(), strict=True):
            yield (k, False, p, p + group.length) if k < n else (int(again[k - n]), True, p, p + group.length)




def deduplicated(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] | None = None,
    length: int = LENGTH,
    gram: int = GRAM,
    block: int = BLOCK,
) -> DataFrame:
    """``row`` (the columns to keep, all if None); ``bytes`` of the text; how many are
    ``removed``, as part of a string of ``length`` bytes that occurs earlier; their
    ``spans``, maximal runs; and the bytes ``kept``."""
    def compute(texts: list[str | None], all_spans: list[list[tuple[int, int]]]) -> list[pa.Array]:
        symbols = Bytes()
        sizes, removed, joined, kept = [], [], [], []
        for value, spans in zip(texts, all_spans, strict=True):
            own = symbols.split(value)
            sizes.append(len(own))
            removed.append(sum(b - a for a, b in spans))
            joined.append([{"start": a, "stop": b} for a, b in spans])
            kept.append(b"".join(remaining(own, spans)))
        return [
            pa.array(sizes, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(joined, SPANS_TYPE),
            pa.array(kept, pa.binary()),
        ]

    return without_repeats(
        docs, key, text, keep, Bytes, length, gram, True,
        lambda data, ids, starts, copied: repeated_bytes(data, ids, starts, copied, length),
        FIELDS, compute, block,
    )
