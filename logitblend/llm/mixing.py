"""Mixing sources to target weights by weighted fair queueing.

Every source offers its documents in shuffled order, up to ``MAX_EPOCHS`` times over.  The
virtual finish time of an offered copy is the number of its source's words up to and
with it, divided by the source's target.  Copies are taken in the order of that time until the
budget, all words, is used up, so every source reaches its target at about the same time, 1.

Copies that finish by time 1 are within the budget in any order, as each source has its target by then; what they leave
over is less than a document for each source.  So the global sort has only the copies that finish after time 1 and
within what is left over, and cuts them where that is used up.  The cut is one place in each source's
queue, and a document needs no more than that place to know how often it is taken: the documents themselves are never
shuffled or sorted.

Only DataFrame functions.  Rows that agree in key, source and text are one *class* with a count, whatever their
number; the places of its members in the queue follow by arithmetic.  No running sum has a source, or the whole
table, in one group: the shuffled order of a source is cut into slices, and the time axis into spans; slices
and spans are summed first, their sums added up, and only then the rows in each of them.

Edge cases: a missing text has size 0; a missing source is a source, the last one; a source
without words has target 0, and its documents are taken once; no documents give no rows; of a class that is
taken in part, as many members as fit, which are alike but for columns that the mix doesn't look at; input
columns with the names of result columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logitblend.llm.common import fresh, integer, text_of, with_total_before, written

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
ROWS_PER_SLICE = 1024
ROWS_PER_SPAN = 4096
SEED = 20_240_602
RESULT = ("size", "source_size", "target", "taken", "copies")


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, size`` (one row for each source) with ``rank`` (by code point, null
    last) and ``target``: the sources share the sum of all sizes by weight, each at
    most ``MAX_EPOCHS`` times its size, the excess shared by weight among the rest.

    With sources sorted by limit / weight, those up to some place are at their limit
    and the others get weight times one common level; the level is the first that
    stays below the next source's ratio.  The windows run over one row per source."""
    everything = Window.partitionBy().rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name).cast("int"))
    weight = F.element_at(F.lit(list(weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        ranked.withColumn("weight", weight.cast("double"))
        .withColumn("limit", F.col("size").cast("double") * MAX_EPOCHS)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    leveled = (
        ranked.withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("all", F.sum(F.col("size").cast("double")).over(everything))
        .withColumn("level", (F.col("all") - F.col("used")) / F.col("open"))
        .withColumn(
            "level",
            F.min(
                F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))
            ).over(everything)["level"],
        )
    )
    share = F.least(F.col("limit"), F.col("weight") * F.col("level"))
    return leveled.select(
        "source", F.col("size").alias("source_size"), "rank", F.coalesce(share, "limit").alias("target")
    )


@dataclass(frozen=True)
class _Names:
    """Names of working columns that the input doesn't have."""

    size: str
    dealt: str
    source: str
    id: str
    edges_source: str
    edges: str
    here: str
    slot: str
    nth: str

    @property
    def place(self) -> list[str]:
        """Columns that order the rows of a source."""
        return [self.dealt, self.id, self.size]


def _names(docs: DataFrame) -> _Names:
    wanted = list(_Names.__dataclass_fields__)
    return _Names(*fresh(docs, *(f"mix_{name}" for name in wanted)))


def _sized(docs: DataFrame, n: _Names, key: str, source: str, text: str, seed: int) -> DataFrame:
    return (
        docs.withColumn(n.size, word_count(text))
        .withColumn(n.dealt, F.xxhash64(F.lit(seed), F.col(key), F.col(source), F.col(text)))
        .withColumn(n.source, F.col(source))
        .withColumn(n.id, F.coalesce(F.col(key).cast("string"), F.lit("")))
    )


def _queue(classes: DataFrame, n: _Names, shares: DataFrame, rows_per_slice: int) -> DataFrame:
    """Classes with the words of their source before them, and what holds for the source."""
    n_slices = max(1, -(-classes.count() // rows_per_slice))
    # Equal cuts of the range of hashes, in order.
    cut = classes.withColumn("slice", F.floor((F.col(n.dealt) / 2.0**64 + 0.5) * n_slices))
    words = F.col(n.size) * F.col("members")
    summed = cut.groupBy(n.source, "slice").agg(F.sum(words).alias("words"))
    ahead = with_total_before(summed, "slice", "words", "ahead", (n.source,)).select(
        F.col(n.source).alias("slice_source"), F.col("slice").alias("slice_number"), "ahead"
    )
    order = Window.partitionBy(n.source, "slice").orderBy(*n.place).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col(n.source).eqNullSafe(F.col("slice_source")) & (F.col("slice") == F.col("slice_number"))
    return (
        cut.join(ahead, same)
        .withColumn("before", F.col("ahead") + F.coalesce(F.sum(words).over(order), F.lit(0)))
        .join(shares, F.col(n.source).eqNullSafe(F.col("source")))
        .select(n.source, *n.place, "members", "before", "source_size", "rank", "target")
    )


def _members_by(n: _Names, place: str, epoch: int) -> Column:
    """How many members of a class finish, in this epoch, by a place in its source's queue."""
    room = f"({place} - {epoch} * source_size - before)"
    # A source without words has one place; its documents are offered once.
    offered = F.lit(True) if not epoch else F.col("source_size") > 0
    fits = F.when(F.col(n.size) > 0, F.expr(f"{room} div {n.size}")).otherwise(F.col("members"))
    some = offered & (F.expr(room) >= 0)
    return F.when(some, F.least(fits, F.col("members"))).otherwise(F.lit(0)).cast("long")


def _last_places(queue: DataFrame, n: _Names, shares: DataFrame, budget: int) -> DataFrame:
    """For each source (``rank``) the place in its queue up to which copies are taken."""
    aimed = queue.withColumn("aim", F.floor("target").cast("long"))
    taken = sum((_members_by(n, "aim", e) for e in range(MAX_EPOCHS)), F.lit(0)) * F.col(n.size)
    left = budget - integer(aimed.agg(F.sum(taken)).first()[0])
    # A source that took more than what is left would not fit.
    reach = aimed.withColumn("reach", F.col("aim") + F.lit(left))
    offers = [
        F.struct(
            F.lit(e).alias("epoch"),
            _members_by(n, "aim", e).alias("first"),
            _members_by(n, "reach", e).alias("end"),
        )
        for e in range(MAX_EPOCHS)
    ]
    finish = F.expr(f"epoch * source_size + before + (k + 1) * {n.size}")
    copies = (
        reach.filter(F.col(n.size) > 0)
        .select("*", F.inline(F.array(*offers)))
        .filter("end > first")
        .withColumn("k", F.explode(F.expr("sequence(first, end - 1)")))
        .withColumn("finish", finish)
        .withColumn("time", F.col("finish").cast("double") / F.col("target"))
        .select("rank", "epoch", *n.place, "k", "finish", "time")
    )
    copies = written(copies, "copies")
    span = copies.agg(F.count(F.lit(1)), F.min("time"), F.max("time")).first()
    n_spans = max(1, span[0] // ROWS_PER_SPAN)
    width = max((span[2] or 0.0) - (span[1] or 0.0), 1e-300)
    copies = copies.withColumn("span", F.floor((F.col("time") - (span[1] or 0.0)) / width * n_spans))
    spans = with_total_before(
        copies.groupBy("span").agg(F.sum(n.size).alias("words")), "span", "words", "words_before"
    ).select("span", "words_before")
    order = Window.partitionBy("span").orderBy("time", "rank", "epoch", *n.place, "k")
    reached = (
        copies.join(spans.filter(F.col("words_before") <= left), "span")
        .withColumn("used", F.col("words_before") + F.sum(n.size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("used") <= left)
        .groupBy("rank")
        .agg(F.max("finish").alias("reached"))
    )
    aim = F.floor("target").cast("long")
    return shares.join(reached, "rank", "left").select(
        "rank", F.greatest(aim, F.coalesce("reached", aim)).alias("last")
    )


def _edges(queue: DataFrame, n: _Names, shares: DataFrame, last: DataFrame) -> DataFrame:
    """For each source, and in it for each epoch, the last class that is taken, with the number of its members,
    and of those that are taken."""
    own = queue.join(last, "rank")
    for e in range(MAX_EPOCHS):
        own = own.withColumn(f"taken_{e}", _members_by(n, "last", e))

    def edge(e: int) -> Column:
        place = F.struct(*[F.col(c).alias(x) for c, x in zip(n.place, ("dealt", "id", "size"), strict=True)])
        entry = F.struct(place.alias("place"), F.col(f"taken_{e}").alias("taken"), "members")
        return F.max(F.when(F.col(f"taken_{e}") > 0, entry))

    found = own.groupBy("rank").agg(
        *[edge(e).alias(f"edge_{e}") for e in range(MAX_EPOCHS)],
    )
    return shares.join(found, "rank", "left").select(
        F.col("source").alias(n.edges_source),
        F.struct(
            "source_size", "target", F.array(*[f"edge_{e}" for e in range(MAX_EPOCHS)]).alias("edges")
        ).alias(n.edges),
    )


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = SEED,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``copies`` (how often
    the mix takes the document, 0 to ``MAX_EPOCHS``) and ``taken`` (their words)."""
    docs = docs.drop(*(c for c in RESULT if c not in (key, source, text)))
    n = _names(docs)
    sized = _sized(docs, n, key, source, text, seed)
    classes = written(
        sized.groupBy(n.source, *n.place).agg(F.count(F.lit(1)).alias("members")), "classes"
    )
    words = F.col(n.size) * F.col("members")
    budget = integer(classes.agg(F.sum(words)).first()[0])
    sizes = classes.groupBy(F.col(n.source).alias("source")).agg(F.sum(words).alias("size"))
    shares = written(targets(sizes, weights), "shares")
    queue = written(_queue(classes, n, shares, rows_per_slice), "queue")
    # One row for each source; written, so that their size is known where they are joined.
    last = written(_last_places(queue, n, shares, budget), "last")
    edges = written(_edges(queue, n, shares, last), "edges")
    found = sized.join(edges, F.col(n.source).eqNullSafe(F.col(n.edges_source))).withColumn(
        n.here, F.struct(*[F.col(c).alias(x) for c, x in zip(n.place, ("dealt", "id", "size"), strict=True)])
    )

    def copies(nth: Column | None) -> Column:
        def of(e: Column) -> Column:
            at_edge = (F.lit(0) if nth is None else nth) < e["taken"]
            here = F.when(F.col(n.here) < e["place"], 1).when((F.col(n.here) == e["place"]) & at_edge, 1)
            return F.when(e.isNotNull(), here.otherwise(0)).otherwise(0)

        return F.aggregate(F.col(f"{n.edges}.edges"), F.lit(0), lambda total, e: total + of(e))

    def report(rows: DataFrame, nth: Column | None) -> DataFrame:
        return rows.withColumn("copies", copies(nth).cast("int")).select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.col(n.size).alias("size"),
            F.col(f"{n.edges}.source_size").alias("source_size"),
            F.col(f"{n.edges}.target").alias("target"),
            (F.col("copies") * F.col(n.size)).cast("long").alias("taken"),
            "copies",
        )

    def is_parted(e: Column) -> Column:
        return F.coalesce(e["taken"] < e["members"], F.lit(False))

    if edges.filter(F.exists(f"{n.edges}.edges", is_parted)).isEmpty():
        return report(found, None)
    in_part = F.exists(f"{n.edges}.edges", lambda e: is_parted(e) & (F.col(n.here) == e["place"]))
    numbered = _numbered(found.filter(in_part), n)
    return report(found.filter(~in_part), None).unionAll(report(numbered, F.col(n.nth)))


def _numbered(rows: DataFrame, n: _Names) -> DataFrame:
    """Members of classes with a number each, from 0: those of a task are numbered there, behind
    those of the tasks before."""
    rows = written(rows.withColumn(n.slot, F.spark_partition_id()), "parted")
    same = [n.source, n.here]
    counted = rows.groupBy(*same, n.slot).agg(F.count(F.lit(1)).alias("own"))
    earlier = Window.partitionBy(*same).orderBy(n.slot).rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.select(
        F.col(n.source).alias("ahead_source"),
        F.col(n.here).alias("ahead_here"),
        F.col(n.slot).alias("ahead_slot"),
        F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("ahead"),
    )
    met = (
        F.col(n.source).eqNullSafe(F.col("ahead_source"))
        & (F.col(n.here) == F.col("ahead_here"))
        & (F.col(n.slot) == F.col("ahead_slot"))
    )
    inside = Window.partitionBy(*same, n.slot).orderBy(F.lit(1))
    return rows.join(ahead, met).withColumn(n.nth, F.col("ahead") + F.row_number().over(inside) - 1)


def mixture(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options
) -> DataFrame:
    """The mix itself: each document, with the columns it has, as often as it is taken."""
    clashing = [c for c in docs.columns if c.lower() in RESULT and c not in (key, source, text)]
    spare = dict(zip(clashing, fresh(docs, *(f"kept_{c}" for c in clashing)), strict=True))
    mix = mixed(docs.withColumnsRenamed(spare), key, source, text, **options)
    (times,) = fresh(mix, "times")
    taken = mix.filter("copies > 0").withColumn(
        times, F.explode(F.sequence(F.lit(1), F.col("copies")))
    )
    return taken.select(*[F.col(f"`{spare.get(c, c)}`").alias(c) for c in docs.columns])
