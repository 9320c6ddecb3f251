"""Near-duplicates by SimHash, searched in BK-trees.

1. Each text becomes a 64-bit fingerprint: the majority, bit by bit, of the XXH64 hashes
   of its shingles.  Equal fingerprints become one row (with the smallest doc_id) before
   anything is compared, so a group of exact copies is one entry, whatever its size.
2. Fingerprints that differ in at most ``radius`` bits agree on at least ``blocks`` -
   ``radius`` of ``blocks`` equal blocks.  Each choice of so many blocks, with their
   bits, names a *shard*; a pair of near fingerprints meets in at least one.
3. A shard is a BK-tree: the children of a node are keyed by their Hamming distance to it,
   and a search follows only edges within the radius of its own distance.  Members search
   as they are inserted; a subtree whose members are already linked to the searcher isn't
   entered again, so a dense group costs about its size, not its pairs.  Links that
   leave a shard are a spanning forest: no pair of different texts loses its connection.
4. Shards beyond ``shard_rows`` members are cut into parts, and each pair of parts
   is one tree: nothing is capped, and no task holds more than two parts at once.
5. Components of all links by alternating large-star and small-star steps, each
   step written to the shared folder; nothing but a row count reaches the driver.

Edge cases: null or empty texts have fingerprint zero and are linked like any other; ties of a
bit (exactly half) are 0; a row without a key is linked by its text, and a component in
which no row has a key is null; repeated rows give repeated result rows; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logitblend.llm.common import over_texts, written

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
SHARD_ROWS = 4096

_ALL = (1 << 64) - 1
# Row b: the bits of byte b, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text's word shingles."""
    own = text.encode("utf-8", "replace").lower().split() if text else []
    if not own:
        return 0
    if len(own) <= shingle:
        shingles = [b" ".join(own)]
    else:
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        shingles = [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        hashes = np.fromiter([digest(s, 42) for s in part], np.uint64, len(part))
        cells = hashes.view(np.uint8).reshape(-1, 8) + _PLACE
        counts += np.bincount(cells.ravel(), minlength=2048)
    ones = np.einsum("kb,bj->kj", counts.reshape(8, 256), _BITS).ravel()
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, shingle: int = SHINGLE
) -> DataFrame:
    """The columns to keep (all, if None) in a struct ``row``, and ``fp``, the fingerprint
    as a long."""

    def prepare():
        return lambda texts: [
            pa.array([fingerprint(t, shingle) for t in texts.to_pylist()], pa.int64())
        ]

    return over_texts(docs, text, keep, "fp long", prepare)


class Tree:
    """BK-tree of one shard, with the components that its searches have found."""

    def __init__(self, radius: int):
        self.radius = radius
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []  # of the union-find forest
        self.same: list[int | None] = []  # the component of a whole subtree, if it is one

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> int:
        i, j = self.root(i), self.root(j)
        if i > j:
            i, j = j, i
        self.parent[j] = i
        return i

    def insert(self, fp: int) -> None:
        """Add a fingerprint; join it with all within the radius."""
        prints, children, same, radius = self.prints, self.children, self.same, self.radius
        me = len(prints)
        prints.append(fp)
        children.append({})
        self.parent.append(me)
        same.append(me)
        if not me:
            return
        stack, mine = [0], me
        while stack:
            node = stack.pop()
            if same[node] is not None and self.root(same[node]) == mine:
                continue
            d = (prints[node] ^ fp).bit_count()
            if d <= radius and self.root(node) != mine:
                mine = self.union(node, mine)
            near = children[node]
            if len(near) <= 2 * radius + 1:
                stack.extend(c for e, c in near.items() if d - radius <= e <= d + radius)
            else:
                stack.extend(near[e] for e in range(d - radius, d + radius + 1) if e in near)
        # Down to its place; what lies above is one component only if it was and still is.
        node, path = 0, []
        while True:
            path.append(node)
            d = (prints[node] ^ fp).bit_count()
            down = children[node].get(d)
            if down is None:
                children[node][d] = me
                break
            node = down
        for node in reversed(path):
            own = self.root(node)
            whole = all(
                same[c] is not None and self.root(same[c]) == own for c in children[node].values()
            )
            same[node] = own if whole else None


def forest(prints: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (fingerprint, smallest of its component in the shard) of distinct signed
    fingerprints."""
    plain = [fp & _ALL for fp in prints]
    if len(prints) == 2:
        return [tuple(sorted(prints))[::-1]] if (plain[0] ^ plain[1]).bit_count() <= radius else []
    tree = Tree(radius)
    for fp in plain:
        tree.insert(fp)
    least: dict[int, int] = {}
    roots = [tree.root(i) for i in range(len(prints))]
    for fp, r in zip(prints, roots, strict=True):
        least[r] = min(fp, least.get(r, fp))
    return [(fp, least[r]) for fp, r in zip(prints, roots, strict=True) if fp != least[r]]


def _shards(radius: int, blocks: int) -> list[tuple[int, int]]:
    """(number, bit mask) of every choice of blocks that near fingerprints may agree on."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    chosen = combinations(masks, blocks - radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [(i, signed(sum(c))) for i, c in enumerate(chosen)]


def links(
    classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Of rows with distinct ``fp``: pairs ``a, b`` of them that connect all
    fingerprints within the radius of each other."""
    masks = F.array(
        *[
            F.struct(F.lit(i).cast("int").alias("choice"), F.lit(m).cast("long").alias("mask"))
            for i, m in _shards(radius, blocks)
        ]
    )
    members = classes.select("fp", F.explode(masks).alias("m")).select(
        "fp", F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("bits")
    )
    counts = (
        members.groupBy("choice", "bits")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
    )
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part")),
            lambda o: F.least(o, F.col("part")) * F.col("parts") + F.greatest(o, F.col("part")),
        )
    )
    placed = (
        members.join(counts, ["choice", "bits"])
        .withColumn("part", part)
        .select("choice", "bits", F.explode(pairs).alias("cell"), "fp")
    )

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard: one tree after the other, also across batches."""
        key, prints = None, []
        out: list[tuple[int, int]] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("choice", "bits", "cell", "fp")]
            for choice, bits, cell, fp in zip(*columns, strict=True):
                if (choice, bits, cell) != key:
                    if len(prints) > 1:
                        out += forest(prints, radius)
                    key, prints = (choice, bits, cell), []
                prints.append(fp)
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        if len(prints) > 1:
            out += forest(prints, radius)
        yield _pairs(out)

    key = ["choice", "bits", "cell"]
    return (
        placed.repartition(*key)
        .sortWithinPartitions(*key, "fp")
        .mapInArrow(trees, "a long, b long")
        .distinct()
    )


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = ([r[k] for r in rows] for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes in pairs ``a, b``: the smallest node reachable.

    Alternates two steps until the edges stay the same.  Large star: every larger
    neighbour of a node is linked to the node's smallest neighbour; small star: every
    smaller one.  Minima are aggregates with partial results, so a star's centre is no
    hot key; joins back to the edges can be split by adaptive execution."""
    edges = written(edges.filter("a != b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        down = large.filter("a != b").distinct()
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        edges = written(small.select("e.*").filter("a != b").distinct(), "edges")
        mark = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        if tuple(mark) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(mark)


def _leads(prints: DataFrame, radius: int, blocks: int, shard_rows: int) -> tuple[DataFrame, ...]:
    """Of rows ``fp, id, tie``: the first row of each component (``root, lead``; a row with
    an id before one without), and each fingerprint's ``root``."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "tie")
    classes = written(prints.groupBy("fp").agg(F.min(order).alias("lead")), "classes")
    found = components(links(classes, radius, blocks, shard_rows))
    linked = classes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "lead", F.coalesce("component", "fp").alias("root")
    )
    return linked.groupBy("root").agg(F.min("lead").alias("lead")), linked.select("fp", "root")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] | None = None,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """For every row: the columns to keep (all, if None) in a struct ``row``; ``fp``;
    ``component``, the smallest key that links reach; ``first``, true for one row of each
    component, one with that key."""
    prints = fingerprints(docs, text, keep, shingle)
    prints = written(prints.withColumn("tie", F.monotonically_increasing_id()), "prints")
    narrow = prints.select("fp", F.col(f"row.`{key}`").alias("id"), "tie")
    leads, roots = _leads(narrow, radius, blocks, shard_rows)
    labels = roots.join(leads, "root").select("fp", "lead")
    return prints.join(labels, "fp").select(
        "row",
        "fp",
        F.col("lead.id").alias("component"),
        (F.col("tie") == F.col("lead.tie")).alias("first"),
    )
