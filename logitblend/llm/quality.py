"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. A document becomes some twenty statistics of its whole text: lengths, shares of
   character classes, repetition, compressibility.
2. Standardised statistics go through random Fourier features, whose inner products
   approximate a Gaussian kernel.
3. Each task sums the normal equations of its labelled rows; the sums of the tasks are
   added up row by row of the matrix, whose size doesn't depend on the data.  The driver
   solves it, with a ridge.
4. The scores of labelled rows are counted in fixed bins and made monotone by pooling
   adjacent violators; the probabilities in between are interpolated.

Edge cases: a missing text is an empty one, and gets a score; labels that are null don't
count; a document labelled more than once counts with the mean; without labels every score is
0.5; with labels of one kind it is that kind's; repeated documents are scored alike, and no
documents give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logitblend.llm.common import fold, over_texts, written

FOURIER = 256
RIDGE = 1.0
SCALE = 1.0
SEED = 20_240_603
BINS = 2048
LOTS = 256
THRESHOLD = 0.7
SLICE = 1000
FOLDS, HELD_OUT = 4, 2

_CLASSES = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (
        65 <= _b <= 90,
        97 <= _b <= 122,
        48 <= _b <= 57,
        _b in b" \t\n\v\f\r",
        _b in b".,;:'\"-()?",
        33 <= _b <= 126 and not _c.isalnum() and _b not in b".,;:'\"-()?",
        _b >= 128,
    )

NAMES = (
    "log_bytes", "log_words", "upper", "lower", "digits", "space", "stops", "symbols", "wide",
    "word_mean", "word_spread", "word_most", "distinct", "repeats", "top_share", "loud",
    "log_lines", "distinct_lines", "line_mean", "ratio",
)


def statistics_of(text: str | None) -> list[float]:
    """The statistics of ``NAMES`` of one whole text."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [0.0] * len(NAMES)
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = (counts @ _CLASSES / n).tolist()
    words = data.split()
    w = len(words)
    if w:
        lengths = np.fromiter(map(len, words), np.float64, w)
        kinds: dict[bytes, int] = {}
        for word in words:
            kinds[word] = kinds.get(word, 0) + 1
        repeats = sum(map(bytes.__eq__, words, words[1:])) / w
        loud = sum(map(bytes.isupper, words)) / w
        own = [
            float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
            len(kinds) / w, repeats, max(kinds.values()) / w, loud,
        ]
    else:
        own = [0.0] * 7
    lines = data.split(b"\n")
    return [
        float(np.log1p(n)),
        float(np.log1p(w)),
        *shares,
        *own,
        float(np.log1p(len(lines))),
        len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        len(zlib.compress(data, 1)) / n,
    ]


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns to keep (all, if None) in a struct ``row``, and ``stats``."""

    def prepare():
        return lambda texts: [
            pa.array([statistics_of(t) for t in texts.to_pylist()], pa.list_(pa.float64()))
        ]

    return over_texts(docs, text, keep, "stats array<double>", prepare)


@dataclass(frozen=True)
class Model:
    """What a score needs; a few hundred numbers for each statistic."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # raw scores, and
    calibrated: np.ndarray  # the probabilities there
    seed: int = SEED

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return expanded(stats, self.mean, self.spread, self.seed) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        # Where calibration is flat, the raw score still tells rows apart.
        return 0.998 * np.interp(raw, self.at, self.calibrated) + 0.002 * np.clip(raw, 0, 1)


def expanded(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray, seed: int) -> np.ndarray:
    """Random Fourier features, with the standardised statistics and a constant."""
    z = np.clip((stats - mean) / spread, -8, 8)
    r = np.random.default_rng(seed)
    d = len(mean)
    directions = r.standard_normal((d, FOURIER)) / (SCALE * np.sqrt(d))
    phases = r.uniform(0, 2 * np.pi, FOURIER)
    waves = np.sqrt(2 / FOURIER) * np.cos(z @ directions + phases)
    return np.hstack([waves, z / np.sqrt(d), np.ones((len(z), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(NAMES))


def labelled(
    stats: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "quality",
    allowed: Column | None = None,
) -> DataFrame:
    """``stats`` and ``y`` of rows with a label; ``allowed`` selects among the labels."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    if allowed is not None:
        usable = usable.filter(allowed)
    y = usable.groupBy(F.col(key).alias("label_key")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    return stats.join(y, F.col(f"row.`{key}`") == F.col("label_key")).select("stats", "y")


def fit(rows: DataFrame, seed: int = SEED) -> Model:
    """A model of labelled rows ``stats, y``."""
    size = len(NAMES)
    rows = written(rows, "labelled")
    moments = rows.agg(
        F.count(F.lit(1)),
        *[f(F.element_at("stats", i + 1)) for i in range(size) for f in (F.avg, F.stddev_pop)],
    ).first()
    if not moments[0]:
        return Model(np.zeros(size), np.ones(size), np.zeros(0), np.zeros(0), np.zeros(0), seed)
    mean, spread = np.array(moments[1::2]), np.array(moments[2::2])
    spread[spread < 1e-9] = 1.0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            x = expanded(_matrix(batch.column("stats")), mean, spread, seed)
            both = np.hstack([x, np.asarray(batch.column("y"))[:, None]])
            total = x.T @ both if not total.size else total + x.T @ both
        lot = [TaskContext.get().partitionId() % LOTS] * len(total)
        terms = pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array(lot, pa.int32()), terms],
            names=["i", "lot", "terms"],
        )

    # Tasks are added up in lots, so that no group grows with their number alone.
    zero = F.array(*[F.lit(0.0)] * (FOURIER + size + 2))
    added = rows.mapInArrow(sums, "i int, lot int, terms array<double>")
    for by in (["i", "lot"], ["i"]):
        added = (
            added.groupBy(*by)
            .agg(F.collect_list("terms").alias("all"))
            .select(
                *by,
                F.aggregate(
                    "all", zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
                ).alias("terms"),
            )
        )
    added = added.orderBy("i")
    system = np.array([r["terms"] for r in added.collect()])
    left, right = system[:, :-1], system[:, -1]
    weights = np.linalg.solve(left + RIDGE * np.eye(len(left)), right)
    return _calibrated(Model(mean, spread, weights, np.zeros(0), np.zeros(0), seed), rows)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column("stats")))
            cell = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y")], names=["bin", "y"])

    bins = (
        rows.mapInArrow(scan, "bin int, y double")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"))
        .orderBy("bin")
        .collect()
    )
    at, y = isotonic([((r["bin"] + 0.5) / BINS * 2 - 0.5, r["y"], r["n"]) for r in bins])
    return Model(model.mean, model.spread, model.weights, at, y, model.seed)


def isotonic(points: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators of (x, y, weight), sorted by x: x and y of the pools'
    ends, for interpolation."""
    pools: list[list[float]] = []  # sum of y, weight, first x, last x
    for x, y, w in points:
        pools.append([y * w, w, x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, weight, _, end = pools.pop()
            pools[-1][0] += total
            pools[-1][1] += weight
            pools[-1][3] = end
    at, values = [], []
    for total, weight, begin, end in pools:
        for x in dict.fromkeys((begin, end)):
            at.append(x)
            values.append(total / weight)
    return np.array(at), np.array(values)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``row`` and ``score``, 0 to 1."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column("stats")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"]
            )

    row = stats.schema["row"].dataType.simpleString()
    return stats.select("row", "stats").mapInArrow(scan, f"row {row}, score double")


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return fold(key, FOLDS) == HELD_OUT


def good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents the classifier accepts, as they are; all, if nothing is labelled."""
    allowed = ~held_out(key)
    known = labels.filter(allowed).select(F.col(key).alias("label_key")).distinct()
    own = docs.join(known, F.col(f"`{key}`") == F.col("label_key"), "left_semi")
    model = fit(labelled(statistics(own, text, (key,)), labels, key, allowed=allowed))
    if not len(model.at):
        return docs

    def prepare():
        def judge(texts: pa.Array) -> list[pa.Array]:
            stats = np.array([statistics_of(t) for t in texts.to_pylist()]).reshape(-1, len(NAMES))
            return [pa.array(model.score(stats), pa.float64())]

        return judge

    judged = over_texts(docs, text, None, "score double", prepare, SLICE)
    return judged.filter(F.col("score") >= THRESHOLD).select("row.*")
