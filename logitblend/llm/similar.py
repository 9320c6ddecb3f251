"""Near copies by Jaccard similarity of word shingles, found by SimHash in BK-trees.

1. A text becomes the set of XXH64 hashes of its 5-word shingles.  Rows whose sets have the same 128-bit hash are one
   *class* before anything is compared, so exact copies are one entry, whatever their number.
2. A class has a SimHash of 1,024 bits.  At a similarity of 0.8 two of them differ in 155 bits on average, with a standard
   deviation of 11.5, at 0.6 in 236; those within ``RADIUS`` bits are candidates.  No choice of agreeing blocks of bits
   is selective at such a distance, so *shards* are named by min-hashes: ``BANDS`` bands of ``BAND`` min-hashes each.  Two sets
   at 0.8 share none of them in 0.04 % of cases; sets at 0.5 share one in 47 % and are then told apart by the SimHash.
3. Each shard is a BK-tree, in which a member searches for candidates as it is inserted; what is linked already isn't searched
   again, so what leaves a shard is a forest, not its pairs.  All classes that are linked are a *cluster*.
4. The sets of a cluster come together once, and similarities are computed from them.  First all members are compared with
   the one in their middle, which joins a dense group; then those outside the largest group with
   all they are a candidate with, unless these are in their group by then.  Again only a forest leaves the task, and no pair
   of different groups that are near copies loses its link.
5. Components are those of all confirmed links.

Shards of more than ``SHARD_ROWS`` members aren't searched: they are part of one cluster as a whole.  Clusters
beyond ``CLUSTER_BYTES`` are cut: each part joins its groups, then the groups' first members do so among themselves, and then the
members outside the largest group, cut into parts, are compared with all members, which stream past.

Edge cases: null or empty texts are copies of each other; a text of fewer words than a shingle is
one shingle; a row without a key is linked by its text; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logitblend.llm.common import fresh, over_texts, written
from logitblend.llm.simhash import _BITS, Tree, components

SHINGLE = 5
SIMILARITY = 0.8
SEEDS = 16  # of 64 bits each
RADIUS = 200
BANDS = 20
BAND = 5
SHARD_ROWS = 16_384
CLUSTER_BYTES = 16 << 20
STARS = 8
TESTED = 64  # candidates at a time
SLICE = 500

_OFFSETS = np.arange(1, SEEDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_CELLS = (np.arange(SEEDS * 8) * 256).reshape(SEEDS, 1, 8)
_DRAWN = np.random.default_rng(20_240_613).integers(0, 1 << 63, (2, BANDS * BAND, 1), dtype=np.uint64)
_SHIFTS, _FACTORS = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    own = text.encode("utf-8", "replace").lower().split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    joined = b" ".join(own)
    digest = xxhash.xxh64_intdigest
    if len(own) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    spans = zip(starts, ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(starts)))


def sketch(hashes: np.ndarray) -> bytes:
    """The SimHash of a set of shingle hashes, 64 bits for each seed."""
    counts = np.zeros(SEEDS * 2048, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        # The finaliser of SplitMix64, once for each seed.
        x = hashes[at : at + (1 << 12)][None, :] + _OFFSETS[:, None]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        cells = x.view(np.uint8).reshape(SEEDS, -1, 8) + _CELLS
        counts += np.bincount(cells.ravel(), minlength=SEEDS * 2048)
    ones = counts.reshape(-1, 256).astype(np.float64) @ _BITS.astype(np.float64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def bands(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each band of min-hashes of a set."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 11):
        turned = (hashes[None, at : at + (1 << 11)] ^ _SHIFTS) * _FACTORS
        np.minimum(least, turned.min(axis=1), out=least)
    mixed = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _number(fp: bytes) -> int:
    return int.from_bytes(fp, "little")


def _prints(docs: DataFrame, text: str, keep: tuple[str, ...], shingle: int) -> DataFrame:
    def prepare():
        def compute(texts: pa.Array) -> list[pa.Array]:
            names, sketches, bands_ = [], [], []
            for t in texts:
                own = shingles(t.as_py(), shingle)
                names.append(xxhash.xxh3_128_digest(own.tobytes(), 7))
                sketches.append(sketch(own))
                bands_.append(bands(own))
            return [
                pa.array(names, pa.binary()),
                pa.array(sketches, pa.binary()),
                pa.array(bands_, pa.list_(pa.int64())),
            ]

        return compute

    fields = "name binary, sketch binary, bands array<bigint>"
    return over_texts(docs, text, keep, fields, prepare, SLICE)


def _sets(docs: DataFrame, text: str, keep: tuple[str, ...], shingle: int) -> DataFrame:
    def prepare():
        def compute(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([shingles(t.as_py(), shingle).tobytes() for t in texts], pa.binary())]

        return compute

    return over_texts(docs, text, keep, "hashes binary", prepare, SLICE)


def _runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by ``key``: the columns of those that share it, also across batches; single
    rows are passed over."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        differs = np.zeros(batch.num_rows - 1, bool)
        for c in key:
            differs |= own[c][1:] != own[c][:-1]
        cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if held and (i or any(held[-1][c][-1] != own[c][a] for c in key)):
                if len(held) > 1 or len(held[0][key[0]]) > 1:
                    yield joined()
                held = []
            if b - a > 1 or b == batch.num_rows or held:
                held.append({c: v[a:b] for c, v in own.items()})
    if held and (len(held) > 1 or len(held[0][key[0]]) > 1):
        yield joined()


class _Out:
    """Rows of longs, gathered into batches."""

    def __init__(self, *names: str):
        self.names, self.rows = names, []

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(self.names)
        made = [pa.array(list(map(int, c)), pa.int64()) for c in columns]
        self.rows = []
        return pa.RecordBatch.from_arrays(made, names=list(self.names))


def forest(nodes: list[int], prints: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (node, first of its group) of all that chains of candidates connect, by a BK-tree."""
    if len(nodes) == 2:
        near = (prints[0] ^ prints[1]).bit_count() <= radius
        return [(max(nodes), min(nodes))] if near else []
    tree = Tree(radius)
    for fp in prints:
        tree.insert(fp)
    least: dict[int, int] = {}
    roots = [tree.root(i) for i in range(len(prints))]
    for node, r in zip(nodes, roots, strict=True):
        least[r] = min(node, least.get(r, node))
    return [(node, least[r]) for node, r in zip(nodes, roots, strict=True) if node != least[r]]


def _apart(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bits in which each row differs from one."""
    return np.bitwise_count(prints ^ one).sum(axis=1, dtype=np.int64)


def are_similar(one: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets (sorted) are as similar to one of them as asked."""
    sizes = np.array([len(s) for s in sets])
    if not len(one):
        return sizes == 0
    every = np.concatenate(sets)
    place = np.minimum(np.searchsorted(one, every), len(one) - 1)
    inside = np.concatenate([[0], np.cumsum(one[place] == every)])
    ends = np.cumsum(sizes)
    both = inside[ends] - inside[ends - sizes]
    return both >= similarity * (len(one) + sizes - both) - 1e-9


class Groups:
    """Members of a cluster, joined by links that were confirmed."""

    def __init__(self, nodes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], similarity: float):
        self.nodes, self.prints, self.sets, self.similarity = nodes, prints, sets, similarity
        self.parent = list(range(len(nodes)))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """Link a member with those of the others that are similar; which these are."""
        found = []
        for at in range(0, len(others), TESTED):
            part = [j for j in others[at : at + TESTED].tolist() if self.root(j) != self.root(i)]
            if not part:
                continue
            good = are_similar(self.sets[i], [self.sets[j] for j in part], self.similarity)
            for j, same in zip(part, good.tolist(), strict=True):
                if same:
                    found.append(j)
                    if self.root(j) != self.root(i):
                        self.parent[self.root(j)] = self.root(i)
                        self.links.append((int(self.nodes[i]), int(self.nodes[j])))
        return found

    def stars(self) -> None:
        """Join members with the one nearest to the middle of all, again for those left over."""
        left = np.arange(len(self.nodes))
        for _ in range(STARS):
            if len(left) < 3:
                return
            bits = np.unpackbits(self.prints[left].view(np.uint8), axis=1)
            middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(left)).view(np.uint64)
            centre = int(left[_apart(self.prints[left], middle).argmin()])
            near = left[(_apart(self.prints[left], self.prints[centre]) <= RADIUS) & (left != centre)]
            joined = self.join(centre, near)
            if not joined:
                return
            left = np.setdiff1d(left, [centre, *joined])

    def rest(self) -> None:
        """Compare what isn't in the largest group with all candidates."""
        roots = np.array([self.root(i) for i in range(len(self.nodes))])
        kinds, sizes = np.unique(roots, return_counts=True)
        if len(kinds) < 2:
            return
        outside = roots != kinds[sizes.argmax()]
        for i in np.flatnonzero(outside).tolist():
            far = _apart(self.prints, self.prints[i])
            near = far <= RADIUS
            near[: i + 1] &= ~outside[: i + 1]  # those were compared with this one
            others = np.flatnonzero(near)
            self.join(i, others[np.argsort(far[others], kind="stable")])


def cluster_links(
    nodes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY
) -> list[tuple[int, int]]:
    """Links that connect all members whose sets are similar, if they are candidates."""
    groups = Groups(nodes, prints, sets, similarity)
    groups.stars()
    groups.rest()
    return groups.links


def _shards(classes: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """``node, band, bits`` of members of shards that have several, and the same with the shard's ``first``
    node of those that have too many to be searched."""
    members = classes.select("node", F.posexplode("bands").alias("band", "bits"))
    counted = members.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    crowded = written(members.join(counted.filter("n > 1"), ["band", "bits"]), "crowded")
    return crowded.filter(F.col("n") <= shard_rows), crowded.filter(F.col("n") > shard_rows)


def _candidate_links(classes: DataFrame, shard_rows: int) -> DataFrame:
    """Links ``a, b`` that connect all candidates."""
    plain, hot = _shards(classes, shard_rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out("a", "b")
        for run in _runs(batches, ("band", "bits")):
            out.rows += forest(run["node"].tolist(), list(map(_number, run["sketch"])))
            if len(out.rows) > 20_000:
                yield out.batch()
        yield out.batch()

    found = (
        plain.join(classes.select("node", "sketch"), "node")
        .select("band", "bits", "node", "sketch")
        .repartition("band", "bits")
        .sortWithinPartitions("band", "bits", "node")
        .mapInArrow(search, "a long, b long")
    )
    whole = hot.select(F.col("node").alias("a"), F.col("first").alias("b")).filter("a != b")
    return found.unionAll(whole).distinct()


def _confirmed(sets: DataFrame, cells: list[str], similarity: float) -> DataFrame:
    """Links ``a, b`` within each cell of rows ``node, sketch, hashes``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out("a", "b")
        for run in _runs(batches, tuple(cells)):
            # A repeated row of the documents is one member.
            nodes, first = np.unique(run["node"], return_index=True)
            prints = np.frombuffer(b"".join(run["sketch"][first]), np.uint64).reshape(len(nodes), -1)
            own = [np.frombuffer(h, np.uint64) for h in run["hashes"][first]]
            out.rows += cluster_links(nodes, prints, own, similarity)
            if len(out.rows) > 20_000:
                yield out.batch()
        yield out.batch()

    return written(
        sets.select(*cells, "node", "sketch", "hashes")
        .repartition(*cells)
        .sortWithinPartitions(*cells, "node")
        .mapInArrow(compare, "a long, b long"),
        "links",
    )


def _in_parts(rows: DataFrame, by: str, cluster_bytes: int, name: str) -> DataFrame:
    """Rows with the number of parts that the rows of one ``by`` must be cut into."""
    size = F.sum(F.octet_length("hashes") + 256)
    parts = rows.groupBy(F.col(by).alias("_by")).agg(F.ceil(size / cluster_bytes).cast("int").alias(name))
    return rows.join(parts, F.col(by) == F.col("_by")).drop("_by")


def _part(parts: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")


def _grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the ``component`` of their node."""
    found = components(links).withColumnRenamed("node", "member")
    joined = rows.join(found, F.col("node") == F.col("member"), "left")
    return joined.select(*rows.columns, F.coalesce("component", "node").alias("component"))


def _links(sets: DataFrame, similarity: float, cluster_bytes: int) -> DataFrame:
    """All confirmed links of the clusters."""
    sized = written(_in_parts(sets, "cluster", cluster_bytes, "parts"), "sized")
    links = _confirmed(sized.filter("parts = 1"), ["cluster"], similarity)
    large = sized.filter("parts > 1")
    if large.isEmpty():
        return links
    asking, own = large, None
    while True:
        asking = asking.withColumn("part", _part("parts"))
        found = _confirmed(asking, ["cluster", "part"], similarity)
        own = found if own is None else own.unionAll(found)
        whole = asking.filter("parts > 1").isEmpty()
        if whole or found.isEmpty():
            break
        # The first members of the groups, of all parts.
        firsts = _grouped(large, own).filter("node = component").drop("component", "parts", "part")
        asking = written(_in_parts(firsts, "cluster", cluster_bytes, "parts"), "firsts")
    grouped = written(_grouped(large.drop("parts"), own), "grouped")
    return links.unionAll(own).unionAll(_outside(grouped, similarity, cluster_bytes))


def _outside(grouped: DataFrame, similarity: float, cluster_bytes: int) -> DataFrame:
    """Links between members outside a cluster's largest group and all others."""
    sizes = grouped.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy(F.col("cluster").alias("_cluster")).agg(
        F.max_by("component", F.struct("n", "component")).alias("largest")
    )
    marked = grouped.join(largest, F.col("cluster") == F.col("_cluster")).drop("_cluster")
    outside = _in_parts(marked.filter("component != largest"), "cluster", cluster_bytes, "cells")
    cells = outside.select(F.col("cluster").alias("_cluster"), "cells").distinct()
    passing = marked.join(cells, F.col("cluster") == F.col("_cluster"))
    columns = ["cluster", "cell", "passes", "node", "component", "sketch", "hashes"]
    both = (
        outside.withColumn("cell", _part("cells"))
        .withColumn("passes", F.lit(False))
        .select(*columns)
        .unionAll(
            passing.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
            .withColumn("passes", F.lit(True))
            .select(*columns)
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, prints = None, [], None
        out = _Out("a", "b")
        for batch in batches:
            for cluster, cell, passes, node, component, sketch_, hashes in zip(
                *(batch.column(c).to_pylist() for c in columns), strict=True
            ):
                if (cluster, cell) != key:
                    key, held, prints = (cluster, cell), [], None
                own = np.frombuffer(hashes, np.uint64)
                if not passes:
                    held.append((node, component, sketch_, own))
                    continue
                if prints is None:
                    prints = np.frombuffer(b"".join(h[2] for h in held), np.uint64).reshape(len(held), -1)
                    groups = np.array([h[1] for h in held])
                near = _apart(prints, np.frombuffer(sketch_, np.uint64)) <= RADIUS
                for k in np.flatnonzero(near & (groups != component)).tolist():
                    if groups[k] != component and are_similar(own, [held[k][3]], similarity)[0]:
                        out.rows.append((node, held[k][0]))
                        # The whole group is linked with this one's by now.
                        groups[groups == groups[k]] = component
            if len(out.rows) > 20_000:
                yield out.batch()
        yield out.batch()

    return written(
        both.repartition("cluster", "cell")
        .sortWithinPartitions("cluster", "cell", "passes", "node")
        .mapInArrow(compare, "a long, b long"),
        "outside",
    )


def deduplicated(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    shard_rows: int = SHARD_ROWS,
    cluster_bytes: int = CLUSTER_BYTES,
) -> DataFrame:
    """One document of each component, as it is: that with the smallest key."""
    id_, version, tie, number = fresh(docs, "chosen_id", "version", "tie", "number")
    # Two hashes of the text: 128 bits.
    content = F.col(text).cast("string")
    marked = docs.withColumn(
        version, F.struct(F.xxhash64(content).alias("h"), F.xxhash64(F.lit(1), content).alias("g"))
    )
    prints = _prints(marked, text, (key, version), shingle)
    order = F.struct(
        F.col(f"row.`{key}`").isNull().alias("none"),
        F.col(f"row.`{key}`").alias("id"),
        F.col(f"row.{version}").alias("tie"),
    )
    classes = written(
        prints.groupBy("name")
        .agg(F.min(order).alias("lead"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
        .drop("name")
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )

    clusters = components(_candidate_links(classes, shard_rows))
    clusters = clusters.select("node", F.col("component").alias("cluster")).unionAll(
        clusters.select(F.col("component").alias("node"), F.col("component").alias("cluster")).distinct()
    )
    wanted = written(
        classes.join(clusters, "node").select(
            "node", "cluster", "sketch", F.col("lead.id").alias(id_), F.col("lead.tie").alias(tie)
        ),
        "wanted",
    )
    # A class has the text of its first row.
    same_row = (F.col(version) == F.col(tie)) & F.col(f"`{key}`").eqNullSafe(F.col(id_))
    texts = marked.join(wanted, same_row).select("node", "cluster", "sketch", F.col(f"`{text}`").alias("content"))
    sets = written(
        _sets(texts, "content", ("node", "cluster", "sketch"), shingle).select("row.*", "hashes"), "sets"
    )
    links = _links(sets, similarity, cluster_bytes)
    leads = _grouped(classes, links).groupBy("component").agg(F.min("lead").alias("lead"))
    chosen = leads.select(F.col("lead.id").alias(id_), F.col("lead.tie").alias(tie))
    staying = marked.join(chosen, same_row, "left_semi")
    plain = [F.col(f"`{c}`") for c in docs.columns]
    # Of rows that agree in key and text, one.
    repeated = written(
        marked.groupBy(F.col(f"`{key}`").alias(id_), F.col(version).alias(tie))
        .agg(F.count(F.lit(1)).alias(number))
        .filter(F.col(number) > 1)
        .drop(number),
        "repeated",
    )
    if repeated.isEmpty():
        return staying.select(*plain)
    same = Window.partitionBy(version, f"`{key}`").orderBy(F.lit(1))
    first = staying.join(repeated, same_row, "left_semi").withColumn(number, F.row_number().over(same))
    alone = staying.join(repeated, same_row, "left_anti")
    return alone.select(*plain).unionAll(first.filter(F.col(number) == 1).select(*plain))
