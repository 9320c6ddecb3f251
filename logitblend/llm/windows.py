"""Finding the windows of symbols that occur more than once, without moving the corpus.

A window is ``length`` consecutive symbols (words, or bytes) of one text.  Its *anchor* is
the smallest of the hashes of its grams (``gram`` symbols each), so equal windows have
equal anchors wherever they occur.  Consecutive windows with one anchor form a *segment*;
there is about one segment for every ``(length - gram) / 2`` symbols, and it travels as six numbers.

Segments of equal content (96 bits of two hashes) are one: the first of them, by document and place, stands for
all, and the others are its *copies*.  This happens inside each task, before the shuffle, and again after it, so a passage
in a third of all documents is one row from each task.  The symbols of those that stand for copies, or share their anchor with others, are cut
out of the texts and dealt by anchor.  An index over each block of them (``substring``, ``suffixes``) finds
what occurs earlier, in them and in their copies; what it reports of a segment's copies is joined back to all of them.  Nothing is
removed that an index hasn't found.

Anchors beyond ``block`` symbols of different segments are cut into parts, and every pair of parts is a
block of its own; nothing is capped, and no block is larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logitblend.llm.common import field_names, written

BLOCK = 1 << 20  # symbols of an index
STRETCH = 1 << 18  # symbols hashed at a time
CHUNK = 300_000  # segments that a task orders at a time
REMEMBERED = 300_000  # words

FACTOR = 0x9E3779B97F4A7C15
_DRAWN = np.random.default_rng(20_240_605).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_HASHES = _DRAWN * np.uint64(2) + np.uint64(1)

SPANS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def mixed(x: np.ndarray) -> np.ndarray:
    """The hashes with every bit spread over all (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor of polynomial hashes, modulo 2^64, and of its inverse."""
    with np.errstate(over="ignore"):
        return tuple(
            np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(x))], dtype=np.uint64)
            for x in (FACTOR, pow(FACTOR, -1, 1 << 64))
        )


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` symbols from each place on; of fewer, and of no use, at the end."""
    power, back = powers(len(hashes))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + length + 1, np.uint64)
        np.cumsum(hashes * power[:-1], out=sums[1 : len(hashes) + 1])
        sums[len(hashes) + 1 :] = sums[len(hashes)]
        return mixed((sums[length : len(hashes) + length] - sums[: len(hashes)]) * back[:-1])


# --- symbols -------------------------------------------------------------------------


class Bytes:
    """Symbols are the bytes of the UTF-8 text."""

    def split(self, text: str | None) -> bytes:
        return text.encode("utf-8", "replace") if text else b""

    def hashes(self, symbols: bytes) -> np.ndarray:
        return BYTE_HASHES[np.frombuffer(symbols, np.uint8)]

    def join(self, symbols: bytes) -> bytes:
        return symbols


class Words:
    """Symbols are the runs of bytes other than ASCII white space."""

    def __init__(self):
        self.memory: dict[bytes, int] = {}

    def split(self, text: str | None) -> list[bytes]:
        return text.encode("utf-8", "replace").split() if text else []

    def hashes(self, symbols: list[bytes]) -> np.ndarray:
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        for word in set(symbols).difference(memory):
            memory[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(memory.__getitem__, symbols), np.uint64, len(symbols))

    def join(self, symbols: list[bytes]) -> bytes:
        return b" ".join(symbols)


# --- segments ------------------------------------------------------------------------


class Segments:
    """Cuts the windows of a text into segments."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.wide = length - gram + 1  # grams of a window
        self.power, self.back = powers(STRETCH + length)

    def of(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """anchor, content and twin (hashes), start, windows, folded: whether the anchor occurs
        more than once in the segment, so that its own windows may be equal."""
        for at in range(0, len(hashes) - self.length + 1, STRETCH):
            yield self._stretch(hashes[at : at + STRETCH + self.length - 1], at)

    def _stretch(self, h: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        with np.errstate(over="ignore"):
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * self.power[: len(h)], out=sums[1:])
            grams = mixed((sums[self.gram :] - sums[: -self.gram]) * self.back[: len(h) - self.gram + 1])
            # High bits of the hash, then the place: the minimum is the leftmost one.
            places = np.uint64(20)
            low = (grams >> places << places) | np.arange(len(grams), dtype=np.uint64)
            span = 1
            while 2 * span <= self.wide:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            rest = self.wide - span
            low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
            place = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
            value = grams[place]
            fresh_run = np.r_[True, value[1:] != value[:-1]]
            moves = np.r_[0, np.cumsum(place[1:] != place[:-1])]
            run = np.flatnonzero(fresh_run)
            ends = np.r_[run[1:], len(value)]
            folded = moves[ends - 1] > moves[run]
            # Long runs (repeated grams) become pieces.
            pieces = -(-(ends - run) // (2 * self.wide))
            if len(pieces) and pieces.max() > 1:
                which = np.repeat(np.arange(len(run)), pieces)
                first = np.cumsum(pieces) - pieces
                start = run[which] + 2 * self.wide * (np.arange(len(which)) - first[which])
                windows = np.minimum(ends[which] - start, 2 * self.wide)
                folded, value_at = folded[which], value[run][which]
            else:
                start, windows, value_at = run, ends - run, value[run]
            stop = start + windows + self.length - 1
            content = mixed((sums[stop] - sums[start]) * self.back[start] + windows.astype(np.uint64))
            # Of another kind than the polynomial: the sum of the grams' hashes, each of which is mixed.
            sums = np.r_[np.uint64(0), np.cumsum(grams)]
            twin = (mixed(sums[stop - self.gram + 1] - sums[start]) >> np.uint64(32)).astype(np.uint32)
        return value_at.view(np.int64), content.view(np.int64), twin.view(np.int32), start + at, windows, folded


_SEGMENT = [
    ("anchor", pa.int64()), ("content", pa.int64()), ("twin", pa.int32()), ("doc", pa.int64()),
    ("start", pa.int32()), ("version", pa.int64()), ("windows", pa.int32()), ("folded", pa.bool_()),
    ("copied", pa.bool_()), ("is_copy", pa.bool_()),
]
_SEGMENT_DDL = (
    "anchor long, content long, twin int, doc long, start int, version long, windows int, "
    "folded boolean, copied boolean, is_copy boolean"
)
_FOLDED, _COPIED, _IS_COPY = 7, 8, 9


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _SEGMENT, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in _SEGMENT])


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where the columns differ from the row before; the first row counts as different."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _united(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted segments: which are the first of their content, and which are to be kept.  The others are marked
    as copies and their first as copied; a repeated row of the documents is no copy."""
    first = _changes(columns[:3])
    kept = first | _changes(columns[:6])
    run = np.cumsum(first) - 1
    copied = np.bincount(run, (kept & ~first) | columns[_COPIED]) > 0
    columns[_COPIED] = copied[run] & first
    columns[_IS_COPY] = ~first
    return first, kept


def _ordered(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Segments of one task, sorted, with those of equal content united."""
    order = np.lexsort(tuple(columns[k] for k in (5, 4, 3, 2, 1, 0)))
    columns = [c[order] for c in columns]
    _, kept = _united(columns)
    return _batch([c[kept] for c in columns])


def _sifted(batches: Iterator[pa.RecordBatch], in_text: bool) -> Iterator[pa.RecordBatch]:
    """Sorted segments of all tasks, copies first: unites those of equal content, drops those that are alone under their
    anchor, and passes on the rest.  Holds one row between batches: the last first of its content."""
    held: list[np.ndarray] | None = None
    several = False  # whether the held one's anchor has had others

    def useful(columns: list[np.ndarray], others: np.ndarray) -> np.ndarray:
        # Windows of a folded segment may be equal to each other.
        return others | columns[_COPIED] | (columns[_FOLDED] & in_text)

    for batch in batches:
        copies = np.asarray(batch.column("is_copy").to_numpy(zero_copy_only=False))
        if copies.any():
            yield batch.filter(pa.array(copies))
            batch = batch.filter(pa.array(~copies))
        if not batch.num_rows:
            continue
        columns = [batch.column(name).to_numpy(zero_copy_only=False) for name, _ in _SEGMENT]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        columns = [np.array(c) for c in columns]
        first, kept = _united(columns)
        group = np.cumsum(_changes(columns[:1])) - 1
        others = np.bincount(group, first) > 1
        others[0] |= several
        out = kept & (~first | useful(columns, others[group]))
        last = int(np.flatnonzero(first)[-1])
        several = bool(others[group[last]])
        held = [c[last : last + 1] for c in columns]
        out[last] = False
        if out.any():
            yield _batch([c[out] for c in columns])
    if held is not None and useful(held, np.array([several]))[0]:
        yield _batch(held)


# --- the whole job ---------------------------------------------------------------------

#: From symbols (joined), docs and starts of segments, and whether they have copies: (segment, whether this holds for its copies or
#: for itself, from, to) of what occurs earlier.
Finder = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, bool, int, int]]]


def without_repeats(
    docs: DataFrame,
    key: str,
    text: str,
    keep: tuple[str, ...] | None,
    kind: type,
    length: int,
    gram: int,
    in_text: bool,
    find: Finder,
    fields: str,
    compute: Callable[[list[str | None], list[list[tuple[int, int]]]], list[pa.Array]],
    block: int = BLOCK,
) -> DataFrame:
    """``row`` (the columns to keep, all if None) and ``fields``, computed from each text and
    the spans of symbols to remove, sorted and apart from each other: those in a window that also starts in a smaller key or,
    with ``in_text``, earlier in the same one.

    The texts are shuffled once: both what is cut out of them and what is left of them comes
    from the same exchange.  It is by key and by the hash of the text, in case
    of several texts with one key."""
    columns = docs.columns if keep is None else list(keep)
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.col(text).cast("string").alias("text"),
        F.col(key).cast("long").alias("doc"),
        F.xxhash64(F.col(text).cast("string")).alias("version"),
    )
    names = ["row", *field_names(fields)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own = compute(part.column("text").to_pylist(), _merged_lists(part.column("spans")))
                yield pa.RecordBatch.from_arrays([part.column("row"), *own], names=names)

    spans = _repeats(base, kind, length, gram, in_text, find, block)
    row = base.schema["row"].dataType.simpleString()
    return (
        base.join(spans.hint("shuffle_hash"), ["doc", "version"], "left")
        .select("row", "text", "spans")
        .mapInArrow(scan, f"row {row}, {fields}")
    )


def _segments(base: DataFrame, kind: type, length: int, gram: int, in_text: bool) -> DataFrame:
    """The segments that others share windows with, and their copies.  A function of its own, so that what was shuffled
    for it can be cleaned up once it is written."""
    own = base.select("doc", "version", "text").filter("doc is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, segments = kind(), Segments(length, gram)
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            for doc, version, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in segments.of(symbols.hashes(symbols.split(value))):
                    k = len(part[0])
                    whose = [np.full(k, doc, np.int64), part[3].astype(np.int32), np.full(k, version, np.int64)]
                    marks = [part[5], np.zeros(k, bool), np.zeros(k, bool)]
                    held.append([*part[:3], *whose, part[4].astype(np.int32), *marks])
                    n += k
                if n >= CHUNK:
                    yield _ordered([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, n = [], 0
        if n:
            yield _ordered([np.concatenate(c) for c in zip(*held, strict=True)])

    segments = own.mapInArrow(cut, _SEGMENT_DDL)
    return written(
        segments.repartition(F.when(F.col("is_copy"), F.xxhash64("version", "start")).otherwise(F.col("anchor")))
        .sortWithinPartitions(F.desc("is_copy"), "anchor", "content", "twin", "doc", "start", "version")
        .mapInArrow(lambda batches: _sifted(batches, in_text), _SEGMENT_DDL),
        "segments",
    )


def _repeats(
    base: DataFrame, kind: type, length: int, gram: int, in_text: bool, find: Finder, block: int
) -> DataFrame:
    """``doc, version, spans`` of texts with symbols to remove."""
    sifted = _segments(base, kind, length, gram, in_text)
    found = _indexed(base, _celled(sifted.filter("not is_copy"), length, block), kind, length, find, block)
    # What was found of a segment holds for itself and for its copies, by whether they come after it.
    same = ["anchor", "content", "twin"]
    reports = found.select(
        *same, F.col("doc").alias("first_doc"), F.col("start").alias("first_start"), "copies", "low", "high"
    )
    later = F.col("doc") > F.col("first_doc")
    if in_text:
        later = later | ((F.col("doc") == F.col("first_doc")) & (F.col("start") > F.col("first_start")))
    return (
        sifted.select(*same, "doc", "version", "start")
        .join(reports, same)
        .filter(F.col("copies") == later)
        .select("doc", "version", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("stop"))
        .groupBy("doc", "version")
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    )


def _celled(open_: DataFrame, length: int, block: int) -> DataFrame:
    """Segments with the number of their block within the anchor: 0, or, where an anchor
    has more symbols than a block, one number for each pair of parts they're in."""
    symbols = F.col("windows") + (length - 1)
    sizes = (
        open_.groupBy("anchor")
        .agg(F.sum(symbols).alias("symbols"))
        .filter(F.col("symbols") > block)
        .select("anchor", F.ceil(2 * F.col("symbols") / block).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("content"), F.col("parts")).cast("int")
    cells = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part")),
            lambda o: F.least(o, F.col("part")) * F.col("parts") + F.greatest(o, F.col("part")),
        )
    )
    return (
        open_.join(sizes, "anchor", "left")
        .withColumn("part", part)
        .select(
            "doc", "version", "anchor", F.explode(cells).alias("cell"), "content", "twin", "start", "windows", "copied"
        )
    )


def _indexed(
    base: DataFrame, open_: DataFrame, kind: type, length: int, find: Finder, block: int
) -> DataFrame:
    """What an index of each block of segments finds: ``low`` to ``high`` of a segment, for itself or its copies."""
    own = ("anchor", "cell", "content", "twin", "start", "windows", "copied")
    lists = open_.groupBy("doc", "version").agg(F.collect_list(F.struct(*own)).alias("segments"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = kind()
        for batch in batches:
            batch = batch.filter(batch.column("segments").is_valid())
            lists = batch.column("segments")
            fields = [f.to_pylist() for f in lists.flatten().flatten()]
            ends = np.cumsum(lists.value_lengths()).tolist()
            rows, size, at = [], 0, 0
            columns = (batch.column(c).to_pylist() for c in ("doc", "version", "text"))
            for doc, version, text, end in zip(*columns, ends, strict=True):
                split = symbols.split(text)
                for anchor, cell, content, twin, a, n, copied in zip(*(f[at:end] for f in fields), strict=True):
                    data = symbols.join(split[a : a + n + length - 1])
                    rows.append((anchor, cell, content, twin, doc, version, a, copied, data))
                    size += len(data)
                at = end
                if size > 16 << 20:
                    yield _cuts(rows)
                    rows, size = [], 0
            if rows:
                yield _cuts(rows)

    # The join has the form of the one in `without_repeats`, down to the columns, so that
    # both read one exchange.
    cuts = (
        base.join(lists.hint("shuffle_hash"), ["doc", "version"], "left")
        .select("row", "text", "doc", "version", "segments")
        .mapInArrow(cut_out, _CUT_DDL)
        .repartition("anchor", "cell")
        .sortWithinPartitions("anchor", "cell", "doc", "start", "version")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != last:
                    if size > block // 2:
                        yield from _search(rows, find)
                        rows, size = [], 0
                    last = row[:2]
                rows.append(row)
                size += len(row[-1])
        if rows:
            yield from _search(rows, find)

    return cuts.mapInArrow(search, _FOUND_DDL)


_CUT_DDL = (
    "anchor long, cell int, content long, twin int, doc long, version long, start int, copied boolean, data binary"
)
_FOUND_DDL = "anchor long, content long, twin int, doc long, start int, copies boolean, low int, high int"


def merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of several owners, those of one that overlap or meet joined; sorted by owner and start."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = (x[order].astype(np.int64) for x in (owner, start, stop))
    # Owners apart from each other on one line.
    line = (owner - owner[0]) * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + line)
    new = np.r_[True, start[1:] + line[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)] - 1
    return owner[first], start[first], reach[last] - line[last]


def _merged_lists(spans: pa.Array) -> list[list[tuple[int, int]]]:
    """The merged spans of each row."""
    lengths = np.asarray(spans.value_lengths().fill_null(0))
    start, stop = (np.asarray(f) for f in spans.flatten().flatten())
    owner, start, stop = merged(np.repeat(np.arange(len(lengths)), lengths), start, stop)
    out: list[list[tuple[int, int]]] = [[] for _ in lengths]
    for k, a, b in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True):
        out[k].append((a, b))
    return out


def _cuts(rows: list[tuple]) -> pa.RecordBatch:
    long, short = pa.int64(), pa.int32()
    types = [long, short, long, short, long, long, short, pa.bool_(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _CUT_DDL.split(", ")])


def _search(rows: list[tuple], find: Finder) -> Iterator[pa.RecordBatch]:
    anchor, _, content, twin, doc, _, start, copied, data = zip(*rows, strict=True)
    whose = [np.array(c, t) for c, t in ((anchor, np.int64), (content, np.int64), (twin, np.int32), (doc, np.int64))]
    starts, marks = np.array(start, np.int64), np.array(copied, bool)
    found = list(find(list(data), whose[3], starts, marks))
    if found:
        k, copies, low, high = (np.array(x, np.int64) for x in zip(*found, strict=True))
        both, low, high = merged(2 * k + copies, low, high)
        k, copies = both // 2, both % 2
        columns = [
            *(c[k] for c in whose), starts[k].astype(np.int32), copies.astype(bool),
            low.astype(np.int32), high.astype(np.int32),
        ]
        names = [f.split()[0] for f in _FOUND_DDL.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def joined(texts: list[np.ndarray], alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of symbols below ``alphabet``, each followed by a smaller symbol that no
    other text has; and where each begins."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    whole = np.empty(int(lengths.sum()) + len(texts), np.int64)
    ends = begins + lengths
    inside = np.ones(len(whole), bool)
    inside[ends] = False
    whole[inside] = np.concatenate(texts).astype(np.int64) + len(texts)
    whole[ends] = np.arange(len(texts))
    return whole, begins


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order by their first ``depth`` symbols at least, by doubling; and the
    ranks by 1, 2, 4, ... symbols.  Each text must end in a symbol of its own."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    ranks, span = [rank.astype(np.int32)], 1
    order = np.argsort(rank)
    while span < depth:
        key = rank * (n + 1)
        key[:-span] += rank[span:] + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        ranks.append(rank.astype(np.int32))
        span *= 2
        if new[-1] == n - 1:
            break
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix in order shares with the one before it (the first: 0)."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        equal = np.zeros(n - 1, bool)
        equal[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        step = equal.astype(np.int64) << level
        shared += step
        a += step
        b += step
    return np.r_[0, shared]

