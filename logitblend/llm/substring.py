"""Substring dedup with an FM-index: words of windows that an earlier document has, too.

``windows`` brings together the segments of text that may share windows of
``WINDOW`` words.  Over each block of them, this module builds an FM-index: the
Burrows-Wheeler transform of the words in a wavelet matrix (one bit vector for each
bit of a word's number, packed, with counts for each 64 bits), a bit vector that marks where suffixes no longer
share a window, and the smallest doc of each such interval.  The suffix array that it is built from isn't kept.

Segments then stream past the index from their ends, all of a block in step: a word more to the left is two rank queries in
the wavelet matrix, and gives the statistic of the next place: how many words match from there, up to a window, and where.
Beyond a window the match is cut back to it by the marks.  Where the statistic is a window, its
interval holds all occurrences, and its smallest doc tells whether an earlier one exists: for the segment itself,
and for its copies in later documents.

Edge cases: a missing text has no words; a row without a key keeps all words, and no
row is earlier or later than it; of rows with one key none is earlier; texts shorter than a
window stay as they are; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logitblend.llm.windows import (
    BLOCK,
    SPANS_TYPE,
    Words,
    common_prefixes,
    joined,
    suffix_array,
    without_repeats,
)

WINDOW = 50
GRAM = 10

FIELDS = "words long, removed long, spans array<struct<start: int, stop: int>>, kept binary"


class BitVector:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)


class WaveletMatrix:
    """A sequence of numbers, with the number of equal ones before any place."""

    def __init__(self, sequence: np.ndarray, alphabet: int):
        self.levels: list[BitVector] = []
        self.shifts = list(range(max(1, (alphabet - 1).bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bits = (sequence >> shift & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            ones = bits.astype(bool)
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        every = np.arange(alphabet)
        self.first = self._down(np.zeros(alphabet, np.int64), every)

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for shift, level in zip(self.shifts, self.levels, strict=True):
            ones = level.rank(at)
            at = np.where(symbol >> shift & 1, level.zeros + ones, at - ones)
        return at

    def rank(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self._down(at, symbol) - self.first[symbol]


class FMIndex:
    """Backward search over texts of numbers, with the smallest doc of every window."""

    def __init__(self, whole: np.ndarray, docs: np.ndarray, depth: int, window: int):
        """``docs`` has the doc of each place of ``whole``."""
        order, ranks = suffix_array(whole, depth)
        counts = np.bincount(whole)
        self.size = len(whole)
        self.smaller = np.cumsum(counts) - counts
        self.transform = WaveletMatrix(whole[order - 1], len(counts))
        apart = common_prefixes(order, ranks) < window
        self.marks = BitVector(apart.astype(np.uint8))
        self.edges = np.r_[np.flatnonzero(apart), len(whole)].astype(np.int32)
        self.least = np.minimum.reduceat(docs[order], self.edges[:-1])

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray):
        """Intervals of suffixes after one symbol more to the left."""
        base = self.smaller[symbol]
        ends = np.concatenate([low, high])
        ranks = self.transform.rank(ends, np.concatenate([symbol, symbol]))
        return base + ranks[: len(low)], base + ranks[len(low) :]

    def cut_back(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of all suffixes that share a window with that at ``low``, and their smallest docs."""
        number = self.marks.rank(low + 1) - 1
        return self.edges[number].astype(np.int64), self.edges[number + 1].astype(np.int64), self.least[number]

    def statistics(
        self, texts: np.ndarray, ends: np.ndarray, lengths: np.ndarray, window: int
    ) -> Iterator[tuple[int, int, np.ndarray]]:
        """Texts that lie one after the other, longest first, read from their ends: for each place from the left end of
        the last window on (``step`` symbols from the end), how many texts reach it, and the smallest docs of their windows there."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for step in range(1, int(lengths[0]) + 1):
            k = int(np.searchsorted(-lengths, -step, side="right"))
            low, high = self.extend(low[:k], high[:k], texts[ends[:k] - step])
            if step >= window:
                low, high, least = self.cut_back(low)
                yield step, k, least


def earlier_windows(
    data: list[bytes], docs: np.ndarray, starts: np.ndarray, copied: np.ndarray, window: int = WINDOW
) -> Iterator[tuple[int, bool, int, int]]:
    """(segment, for its copies or itself, from, to): words of windows that a smaller doc's segment has, too; a
    copy's doc is larger than the segment's."""
    numbers: dict[bytes, int] = {}
    texts = [np.array([numbers.setdefault(w, len(numbers)) for w in d.split()], np.int64) for d in data]
    lengths = np.array([len(t) for t in texts])
    whole, begins = joined(texts, len(numbers))
    index = FMIndex(whole, np.repeat(docs, lengths + 1), int(lengths.max()) + 1, window)
    by_length = np.argsort(-lengths, kind="stable")
    longest = lengths[by_length]
    own_doc, has_copies = docs[by_length], copied[by_length]
    hits: tuple[list, list] = ([], [])  # for segments, and for their copies
    for step, k, least in index.statistics(whole, (begins + lengths)[by_length], longest, window):
        for found, hit in zip(hits, (least < own_doc[:k], has_copies[:k] & (least <= own_doc[:k])), strict=True):
            at = np.flatnonzero(hit)
            found.append((by_length[at], longest[at] - step))
    for copies, found in enumerate(hits):
        if not found:
            continue
        segment, place = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(segment):
            continue
        order = np.lexsort((place, segment))
        segment, place = segment[order], place[order]
        new = np.r_[True, (np.diff(segment) != 0) | (np.diff(place) != 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(segment)] - 1
        for k, a, b in zip(segment[first].tolist(), place[first].tolist(), (place[last] + window).tolist(), strict=True):
            yield k, bool(copies), a, b


def remaining(symbols, spans: list[tuple[int, int]]) -> list:
    """The parts between the spans."""
    edges = [0, *(x for s in spans for x in s), len(symbols)]
    return [symbols[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def deduplicated(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] | None = None,
    window: int = WINDOW,
    gram: int = GRAM,
    block: int = BLOCK,
) -> DataFrame:
    """``row`` (the columns to keep, all if None); ``words``, how many the text has;
    ``removed``, how many of them an earlier document has in a window, too; their ``spans``; and
    the ``kept`` words joined by a space, as UTF-8."""
    def compute(texts: list[str | None], all_spans: list[list[tuple[int, int]]]) -> list[pa.Array]:
        symbols = Words()
        words, removed, joined, kept = [], [], [], []
        for value, spans in zip(texts, all_spans, strict=True):
            own = symbols.split(value)
            words.append(len(own))
            removed.append(sum(b - a for a, b in spans))
            joined.append([{"start": a, "stop": b} for a, b in spans])
            kept.append(b" ".join(w for part in remaining(own, spans) for w in part))
        return [
            pa.array(words, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(joined, SPANS_TYPE),
            pa.array(kept, pa.binary()),
        ]

    return without_repeats(
        docs, key, text, keep, Words, window, gram, False,
        lambda data, ids, starts, copied: earlier_windows(data, ids, starts, copied, window),
        FIELDS, compute, block,
    )
