"""Toxicity: a linear-chain conditional random field that tags toxic words.

1. Labelled documents tell which words and word beginnings occur in toxic documents and
   hardly in others, beyond chance.  These mark the words of the toxic documents: labelled tokens.  A toxic document without any
   of them isn't learnt from, as none of its words is known to be clean or toxic.
2. The field has two tags; a token's features are the word, its beginnings, its end and
   its length, hashed.  It is trained by iterative parameter mixing: each partition
   of the labelled tokens climbs the log-likelihood from the shared weights, and
   the weights of the partitions are averaged.
3. Forward-backward over every whole text gives each word's probability of the toxic
   tag.  A document's score is the probability that any of the words above one half (of all,
   if there are none: the highest) is toxic, calibrated by a logistic curve; its spans are
   the words above one half.

Training uses at most about ``SAMPLE`` labelled documents, drawn by a hash of the key;
everything else covers all documents.

Edge cases: a missing text is an empty one, without spans and with a low score;
null labels don't count; a document labelled more than once is toxic if the mean is at least
a half; repeated texts are learnt from once; without toxic labels, or without any
others, every score is 0; no documents give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logitblend.llm.common import fold, over_texts, written

SAMPLE = 16_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
SEED = 20_240_604

HASHED = 1 << 16  # weights of hashed features, a power of two; one more for the constant
_MASK = HASHED - 1
CHUNK = 128  # words of a training sequence
PARTS, ROUNDS, STEPS = 6, 3, 40
DECAY = 1e-6
CACHED = 300_000  # words whose weight a task remembers
CELLS = 2_000_000  # of a forward-backward table
SLICE = 1 << 17  # tokens whose pairs are added up at a time
LEAST_SUPPORT = 3
FALSE_RATE = 0.2  # of clues
AT_ONCE = 2048  # texts

_STRIP = b" .,;:!?\"'()[]{}<>*#$%&@~^|/\\-_+="
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))


def bare(token: bytes) -> bytes:
    return token.lower().strip(_STRIP)


def features(token: bytes) -> list[int]:
    """Hashed features of a token as it stands in the text: its length, the word, its end, and
    its beginnings; each kind starts the hash with a number of its own."""
    word = bare(token)
    n = len(word)
    found = [crc32(b"", min(n, 20)) & _MASK, crc32(word, 100) & _MASK]
    if n > 2:
        found.append(crc32(word[-3:], 101) & _MASK)
        for k in range(3, min(n, 6) + 1):
            found.append(crc32(word[:k], k) & _MASK)
    return found


def clues(word: bytes) -> list[bytes]:
    """What may mark a word: itself, and its beginnings."""
    return [b"w" + word, *(b"%d" % k + word[:k] for k in (4, 5) if len(word) > k)]


@dataclass(frozen=True)
class Field:
    """Weights of the features for tag 1 against 0, and of tag pairs."""

    weights: np.ndarray
    pairs: np.ndarray  # 2 x 2, row: the tag before
    slope: float = 1.0
    shift: float = 0.0

    def emissions(self):
        """The function from a token to its log odds of tag 1 by itself."""
        weights = self.weights.tolist()
        constant = weights.pop()
        return lambda token: sum(map(weights.__getitem__, features(token)), constant)


def sweeps(
    emissions: np.ndarray, lengths: np.ndarray, pairs: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences in the columns of ``emissions``, sorted by length, longest first: the
    emissions' odds, and the forward and backward sums of each step as odds of tag 1."""
    steps, _ = emissions.shape
    e = np.exp(np.clip(emissions, -30, 30))
    (t00, t01), (t10, t11) = np.exp(pairs)
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    ahead, behind = np.zeros_like(e), np.ones_like(e)
    ahead[0] = e[0]
    for t in range(1, steps):
        k = live[t]
        odds = ahead[t - 1, :k]
        ahead[t, :k] = e[t, :k] * (t01 + odds * t11) / (t00 + odds * t10)
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        on = e[t + 1, :k] * behind[t + 1, :k]
        behind[t, :k] = (t10 + on * t11) / (t00 + on * t01)
    return e, ahead, behind


def probabilities(emissions: list[np.ndarray], pairs: np.ndarray) -> list[np.ndarray]:
    """Probability of tag 1 for each word of each text."""
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    out: list[np.ndarray] = [np.zeros(0)] * len(emissions)
    at = 0
    while at < len(order) and len(emissions[order[at]]):
        steps = len(emissions[order[at]])
        group = [i for i in order[at : at + max(1, CELLS // steps)] if len(emissions[i])]
        # A group ends where padding would take most of the table.
        group = [i for i in group if 4 * len(emissions[i]) >= steps] if steps > 64 else group
        table = np.zeros((len(group), steps))
        for row, i in zip(table, group, strict=True):
            row[: len(emissions[i])] = emissions[i]
        lengths = np.array([len(emissions[i]) for i in group])
        _, ahead, behind = sweeps(np.ascontiguousarray(table.T), lengths, pairs)
        odds = ahead * behind
        for k, i in enumerate(group):
            own = odds[: lengths[k], k]
            out[i] = own / (1 + own)
        at += len(group)
    return out


def evidence(p: np.ndarray) -> float:
    """Log odds, within bounds, that any of the tagged words is toxic; of the most suspect
    word, if none is tagged.  Words that aren't suspect add nothing, however many."""
    if not len(p):
        return -15.0
    tagged = np.minimum(p[p >= 0.5] if p.max() >= 0.5 else p.max(), 1 - 1e-12)
    none = float(np.log1p(-tagged).sum())
    return min(15.0, max(-15.0, math.log(max(-math.expm1(none), 1e-12)) - none))


def _tagger(field: Field):
    """The function from texts to tokens and probabilities, with a memory of words."""
    memory: dict[bytes, float] = {}
    emission = field.emissions()

    def tag(texts: list[str | None]) -> tuple[list[list[bytes]], list[np.ndarray]]:
        tokens = [(t or "").encode("utf-8", "replace").split() for t in texts]
        emissions = []
        for own in tokens:
            for token in set(own).difference(memory):
                memory[token] = emission(token)
            emissions.append(np.fromiter(map(memory.__getitem__, own), np.float64, len(own)))
            if len(memory) > CACHED:
                memory.clear()
        return tokens, probabilities(emissions, field.pairs)

    return tag


# --- training ------------------------------------------------------------------------


def sample(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    allowed: Column | None = None,
    bound: int = SAMPLE,
) -> DataFrame:
    """``text, toxic`` of at most about ``bound`` labelled documents, different texts."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    if allowed is not None:
        usable = usable.filter(allowed)
    n = usable.count()
    drawn = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 20)) < max(
        1, min(1 << 20, (bound << 20) // max(n, 1))
    )
    toxic = (
        usable.filter(drawn)
        .groupBy(F.col(key).alias("label_key"))
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).alias("toxic"))
    )
    own = docs.filter(drawn).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    joined = own.join(toxic, F.col("id") == F.col("label_key")).filter("text is not null")
    return joined.groupBy("text").agg(F.max("toxic").alias("toxic"))


def lexicon(rows: DataFrame) -> dict[bytes, float]:
    """Clues to toxicity with their weight: documents with them, times log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic")), strict=True):
                own = {bare(t) for t in text.encode("utf-8", "replace").split()} - {b""}
                for clue in {c for word in own for c in clues(word)}:
                    seen.setdefault(clue, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(seen), pa.binary()),
                pa.array([v[0] for v in seen.values()], pa.int64()),
                pa.array([v[1] for v in seen.values()], pa.int64()),
            ],
            names=["clue", "clean", "toxic"],
        )

    totals = rows.agg(F.sum(F.col("toxic").cast("int")), F.count(F.lit(1))).first()
    bad, good = totals[0] or 0, totals[1] - (totals[0] or 0)
    if not bad or not good:
        return {}
    odds = F.log(((F.col("toxic") + 0.5) / (bad + 1)) / ((F.col("clean") + 0.5) / (good + 1)))
    counts = written(
        rows.mapInArrow(count, "clue binary, clean long, toxic long")
        .groupBy("clue")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("clean") + F.col("toxic") >= LEAST_SUPPORT),
        "clues",
    )
    # How unlikely it is (Chernoff) that so many of its documents are toxic by chance.
    n, share = F.col("clean") + F.col("toxic"), bad / (bad + good)
    unlikely = F.col("toxic") * F.log(F.col("toxic") / n / share) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - share))
    ).otherwise(0.0)
    likely = counts.filter((F.col("toxic") >= LEAST_SUPPORT) & (odds >= 2.5)).withColumn("unlikely", unlikely)
    # One row for each pair of counts.
    levels = likely.groupBy("unlikely").count().orderBy(F.desc("unlikely")).collect()
    least = significant([(r["unlikely"], r["count"]) for r in levels], counts.count())
    # At most a few hundred clues for each document of the sample have the support.
    found = likely.filter(F.col("unlikely") >= least).select("clue", (F.col("toxic") * odds).alias("weight"))
    return {bytes(r["clue"]): r["weight"] for r in found.collect()}


def significant(levels: list[tuple[float, int]], tested: int, rate: float = FALSE_RATE) -> float:
    """The lowest level (minus log of the chance) at which no more than a share ``rate`` of what reaches it does so by
    chance, of all that was tested; levels fall, with their counts (Benjamini and Hochberg)."""
    found, least = 0, math.inf
    for level, n in levels:
        found += n
        if tested * math.exp(-level) <= rate * found:
            least = level
    return least


def tags(tokens: list[bytes], toxic: bool, clue_weight: dict[bytes, float]) -> np.ndarray | None:
    """Tag of each token: in a toxic document, 1 if its weight comes near that of the
    document's most telling token.  None if it has no clue: which of its words are toxic isn't known."""
    if not toxic:
        return np.zeros(len(tokens))
    kinds = {t: max((clue_weight.get(c, 0.0) for c in clues(bare(t))), default=0.0) for t in set(tokens)}
    most = max(kinds.values(), default=0.0)
    if not most:
        return None
    return np.array([float(kinds[t] > 0 and kinds[t] >= 0.25 * most) for t in tokens])


def climb(field: Field, texts: list[str], toxic: list[bool], clue_weight: dict[bytes, float]) -> Field:
    """Weights after some steps up the log-likelihood of these documents' tags."""
    kinds: dict[bytes, int] = {}
    ids, gold, ends = [], [], []
    for text, bad in zip(texts, toxic, strict=True):
        tokens = text.encode("utf-8", "replace").split()
        own = tags(tokens, bad, clue_weight)
        if own is None:
            continue
        ids.append(np.fromiter((kinds.setdefault(t, len(kinds)) for t in tokens), np.int32, len(tokens)))
        gold.append(own)
        ends += [min(CHUNK, len(tokens) - a) for a in range(0, len(tokens), CHUNK)]
    n = sum(ends)
    if not n:
        return field
    lengths = np.array(ends)
    order = np.argsort(-lengths, kind="stable")
    # Place of every token in the table, steps by sequences, longest first.
    column = np.empty(len(lengths), np.int64)
    column[order] = np.arange(len(lengths))
    step = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    cell = (step * len(lengths) + np.repeat(column, lengths)).astype(np.int32)
    flat, y = np.concatenate(ids), np.concatenate(gold)
    lists = [np.array(features(t), np.int32) for t in kinds]
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    feature = np.concatenate(lists)
    lengths = lengths[order]
    after = cell[step > 0]  # tokens with one before them in their sequence
    before = after - len(lengths)
    y_table = np.zeros(lengths[0] * len(lengths))
    y_table[cell] = y
    gold_pairs = np.bincount((2 * y_table[before] + y_table[after]).astype(np.int8), minlength=4)
    del ids, gold, step, lists, y_table, column

    weights, pairs = field.weights.copy(), field.pairs.copy()
    state = [np.zeros(HASHED + 5), np.zeros(HASHED + 5)]
    for t in range(1, STEPS + 1):
        kind_score = np.bincount(owner, weights[feature], len(kinds)) + weights[HASHED]
        table = np.zeros(lengths[0] * len(lengths))
        table[cell] = kind_score[flat]
        table = table.reshape(lengths[0], len(lengths))
        e, ahead, behind = (x.ravel() for x in sweeps(table, lengths, pairs))
        odds = ahead[cell] * behind[cell]
        slack = np.bincount(flat, y - odds / (1 + odds), len(kinds))
        up = np.zeros(HASHED + 5)
        up[:HASHED] = np.bincount(feature, slack[owner], HASHED)
        up[HASHED] = slack.sum()
        up[HASHED + 1 :] = gold_pairs
        for at in range(0, len(after), SLICE):
            own, last = after[at : at + SLICE], before[at : at + SLICE]
            f, on = ahead[last], e[own] * behind[own]
            both = np.exp(pairs)[:, :, None] * np.array([[np.ones_like(f), on], [f, f * on]])
            up[HASHED + 1 :] -= (both / both.sum((0, 1))).sum(2).ravel()
        all_weights = np.concatenate([weights, pairs.ravel()])
        up -= DECAY * n * all_weights
        state[0] = 0.9 * state[0] + 0.1 * up
        state[1] = 0.99 * state[1] + 0.01 * up * up
        all_weights += 0.15 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        weights, pairs = all_weights[: HASHED + 1], all_weights[HASHED + 1 :].reshape(2, 2)
    return Field(weights, np.clip(pairs, -4, 4))


def fit(rows: DataFrame) -> Field | None:
    """A field trained on rows ``text, toxic``; None if they aren't of both kinds."""
    rows = written(rows.repartition(PARTS, F.xxhash64("text")), "labelled")
    clue_weight = lexicon(rows)
    if not clue_weight:
        return None
    field = Field(np.zeros(HASHED + 1), np.zeros((2, 2)))
    field.weights[HASHED] = -4.0
    for _ in range(ROUNDS):
        field = _mixed(rows, field, clue_weight)
    return _calibrated(rows, field)


def _mixed(rows: DataFrame, field: Field, clue_weight: dict[bytes, float]) -> Field:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        toxic: list[bool] = []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        if texts:
            own = climb(field, texts, toxic, clue_weight)
            data = np.concatenate([own.weights, own.pairs.ravel()]).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["weights"])

    parts = rows.repartition(PARTS, F.xxhash64("text")).mapInArrow(train, "weights binary").collect()
    mean = np.mean([np.frombuffer(r["weights"], np.float32) for r in parts], axis=0, dtype=np.float64)
    return Field(mean[: HASHED + 1], mean[HASHED + 1 :].reshape(2, 2))


def _calibrated(rows: DataFrame, field: Field) -> Field:
    """The field with a logistic curve from evidence to labels, fitted to bins."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = _tagger(field)
        for batch in batches:
            _, found = tag(batch.column("text").to_pylist())
            bins = [round(8 * evidence(p)) for p in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bins, pa.int32()), batch.column("toxic")], names=["bin", "toxic"]
            )

    bins = (
        rows.mapInArrow(scan, "bin int, toxic boolean")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("int")).alias("y"))
        .collect()
    )
    x, n, y = (np.array([r[c] for r in bins], float) for c in ("bin", "n", "y"))
    x = x / 8
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps, with a weak prior on slope 1
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        grad = np.array([((y - n * p) * x).sum() - (a - 1), (y - n * p).sum()])
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return Field(field.weights, field.pairs, max(a, 1e-3), b)


# --- use -----------------------------------------------------------------------------


def scored(
    docs: DataFrame, field: Field | None, text: str = "text", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """The columns to keep (all, if None) in a struct ``row``; ``score``, 0 to 1; ``spans``,
    the toxic words: bytes of the text from start to stop, and probability."""

    def prepare():
        tag = _tagger(field) if field else None

        def run(texts: pa.Array) -> list[pa.Array]:
            if tag is None:
                return [pa.array([0.0] * len(texts)), pa.array([[]] * len(texts), _SPAN)]
            scores: list[float] = []
            spans: list[list[dict]] = []
            own = texts.to_pylist()
            tokens, found = tag(own)
            for words, p, t in zip(tokens, found, own, strict=True):
                z = field.slope * evidence(p) + field.shift
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                spans.append(offsets(t, words, p))
            return [pa.array(scores, pa.float64()), pa.array(spans, _SPAN)]

        return run

    fields = "score double, spans array<struct<start: int, stop: int, p: double>>"
    return over_texts(docs, text, keep, fields, prepare, AT_ONCE)


def offsets(text: str | None, words: list[bytes], p: np.ndarray) -> list[dict]:
    """Where the words above one half lie in the UTF-8 text."""
    if not len(p) or p.max() < 0.5:
        return []
    data, at, out = (text or "").encode("utf-8", "replace"), 0, []
    for word, own in zip(words, p.tolist(), strict=True):
        at = data.index(word, at)
        if own >= 0.5:
            out.append({"start": at, "stop": at + len(word), "p": own})
        at += len(word)
    return out


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return fold(key, FOLDS) == HELD_OUT
