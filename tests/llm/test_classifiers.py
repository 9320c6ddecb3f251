"""Quality and toxicity."""

import random
import zlib

import brute
import numpy as np
import pytest

from logitblend.llm import quality, toxicity

BAD = ["grubble", "snark", "vexmoor", "vextall", "vexpine"]


def fold(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus


def documents(n=400):
    """Rows, quality labels and toxic labels: junk repeats or shouts, toxic texts
    have a word or two of ``BAD``."""
    rows, labels = [], []
    r = random.Random(11)
    for i in range(n):
        text, good, toxic = brute.prose(i, 20 + i % 60, 3000), 1, 0
        if i % 4 == 1:
            good = 0
            text = ("buy now! " * (5 + i % 9)) if i % 8 == 1 else text.upper().replace(" ", "!!! ")
        elif i % 4 == 2:
            toxic = 1
            words = text.split()
            words[r.randrange(len(words))] = r.choice(BAD[:2]) if i % 8 == 2 else "vex" + words[0]
            text = " ".join(words)
        rows.append((i, text, f"s{i % 3}"))
        labels.append((i, good, toxic))
    rows += [(n, "", "s0"), (n + 1, None, None), (None, "no key at all", "s1"), (n + 2, brute.prose(5, 20_000), "s1")]
    return rows, labels


@pytest.fixture
def labelled(spark, frame):
    rows, labels = documents()
    # Labels that must not be learnt from are all wrong.
    wrong = [
        (i, 1 - q if fold(i, 4) == 2 else q, 1 - t if fold(i, 5) == 0 else t) for i, q, t in labels
    ]
    wrong += [(0, wrong[0][1], wrong[0][2]), (1, None, None), (None, 1, 1)]
    table = spark.createDataFrame(wrong, "doc_id long, quality int, toxic int")
    return frame(rows), table, {i: (q, t) for i, q, t in labels}


def test_quality_of_documents_not_learnt_from(labelled):
    docs, labels, truth = labelled
    stats = quality.statistics(docs, keep=("doc_id", "n"))
    model = quality.fit(quality.labelled(stats, labels, allowed=~quality.held_out()))
    got = quality.scored(stats, model).selectExpr("row.doc_id", "row.n", "score").collect()
    assert len(got) == docs.count() and {r.n for r in got} == {"kept"}
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and fold(r.doc_id, 4) == 2]
    right = [(r.score >= 0.7) == bool(truth[r.doc_id][0]) for r in held]
    assert len(held) > 50 and np.mean(right) > 0.95


def test_good_documents_stay_as_they_are(labelled):
    docs, labels, truth = labelled
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    good = {i for i, (q, _) in truth.items() if q}
    assert len(good - ids) <= 5 and len(ids & (set(truth) - good)) <= 5


def test_quality_without_labels(spark, frame, labelled):
    docs, labels, _ = labelled
    none = labels.filter("doc_id < 0")
    assert quality.good(docs, none).count() == docs.count()
    stats = quality.statistics(docs)
    model = quality.fit(quality.labelled(stats, none))
    assert {r.score for r in quality.scored(stats, model).collect()} == {0.5}
    empty = frame([])
    assert quality.good(empty, labels).count() == 0
    model = quality.fit(quality.labelled(stats, labels.filter("quality = 1")))
    assert min(r.score for r in quality.scored(stats, model).collect()) > 0.9


def test_isotonic_is_monotone_and_keeps_the_mean():
    r = random.Random(2)
    points = [(x / 50, float(r.random() < x / 50), 1 + x % 3) for x in range(51)]
    at, y = quality.isotonic(points)
    assert (np.diff(at) > 0).all() and (np.diff(y) >= 0).all()
    fitted = np.interp([p[0] for p in points], at, y)
    assert np.average(fitted, weights=[p[2] for p in points]) == pytest.approx(
        np.average([p[1] for p in points], weights=[p[2] for p in points]), abs=0.05
    )


def test_fourier_features_approximate_the_kernel():
    r = np.random.default_rng(1)
    x = r.standard_normal((40, 20))
    f = quality.expanded(x, np.zeros(20), np.ones(20), 7)[:, : quality.FOURIER]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 20 * quality.SCALE**2))
    assert np.abs(f @ f.T - exact).max() < 0.3


def test_toxic_documents_not_learnt_from(labelled):
    docs, labels, truth = labelled
    field = toxicity.fit(toxicity.sample(docs, labels, allowed=~toxicity.held_out()))
    found = toxicity.scored(docs, field, keep=("doc_id", "text")).select("row.*", "score", "spans").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r.doc_id in truth and fold(r.doc_id, 5) == 0]
    right = [(r.score >= 0.5) == bool(truth[r.doc_id][1]) for r in held]
    assert len(held) > 50 and np.mean(right) > 0.95
    words = [
        r.text.encode()[s.start : s.stop].decode() for r in found for s in r.spans if truth.get(r.doc_id, (0, 0))[1]
    ]
    assert words and np.mean([w in BAD or w.startswith("vex") for w in words]) > 0.9
    by_id = {r.doc_id: r.score for r in found}
    assert by_id[400] < 0.5 and by_id[401] < 0.5 and by_id[402] < 0.5


def test_many_rare_toxic_words_are_learnt(spark):
    """250 toxic words, each in six of 1,500 toxic documents."""
    r = random.Random(9)
    bad = ["".join(r.choice("qxzvj") + r.choice("aeiou") for _ in range(4)) for _ in range(250)]
    rows = []
    for i in range(7500):
        words = ["w%d" % r.randrange(400) for _ in range(12)]
        if i < 1500:
            words.insert(r.randrange(12), bad[i % 250])
        rows.append((" ".join(words), i < 1500))
    texts = spark.createDataFrame(rows, "text string, toxic boolean")
    field = toxicity.fit(texts)
    asked = [(k, " ".join(["w%d" % r.randrange(400) for _ in range(10)] + ([bad[k]] if k < 250 else []))) for k in range(500)]
    found = toxicity.scored(spark.createDataFrame(asked, "doc_id long, text string"), field, keep=("doc_id",)).collect()
    right = [(row.score >= 0.5) == (row.row.doc_id < 250) for row in found]
    assert np.mean(right) > 0.95


def test_clues_beyond_chance():
    # 10 at a chance of e^-12 and 40 at e^-8 of 1,000 tested: 0.3 by chance; 500 more at e^-1: hundreds.
    levels = [(12.0, 10), (8.0, 40), (1.0, 500)]
    assert toxicity.significant(levels, 1000, 0.2) == 8.0
    assert toxicity.significant(levels, 10**5, 0.2) == 12.0
    assert toxicity.significant([(1.0, 5)], 1000, 0.2) == float("inf")
    assert toxicity.significant([], 1000, 0.2) == float("inf")


def test_toxic_documents_without_a_clue_teach_nothing():
    assert toxicity.tags([b"plain", b"words"], True, {b"wbad": 3.0}) is None
    assert toxicity.tags([b"plain", b"bad"], True, {b"wbad": 3.0}).tolist() == [0.0, 1.0]
    assert toxicity.tags([b"plain", b"bad"], False, {b"wbad": 3.0}).tolist() == [0.0, 0.0]
    start = toxicity.Field(np.zeros(toxicity.HASHED + 1), np.zeros((2, 2)))
    assert toxicity.climb(start, ["plain words"], [True], {b"wbad": 3.0}) is start


def test_toxicity_without_toxic_labels(frame, labelled):
    docs, labels, _ = labelled
    for some in (labels.filter("toxic = 0"), labels.filter("doc_id < 0"), labels.filter("toxic = 1")):
        field = toxicity.fit(toxicity.sample(docs, some))
        assert {r.score for r in toxicity.scored(docs, field).collect()} == {0.0}
    assert toxicity.scored(frame([]), field).count() == 0


def test_sums_over_all_paths():
    """Forward-backward against every sequence of tags."""
    from itertools import product

    r = np.random.default_rng(5)
    lengths = np.array([6, 4, 4, 1])
    table, pairs = r.standard_normal((6, 4)), r.standard_normal((2, 2))
    _, ahead, behind = toxicity.sweeps(table, lengths, pairs)
    odds = ahead * behind
    for c, n in enumerate(lengths):
        weight = np.zeros((n, 2))
        for tags in product((0, 1), repeat=int(n)):
            score = sum(table[t, c] for t in range(n) if tags[t])
            score += sum(pairs[a, b] for a, b in zip(tags, tags[1:], strict=False))
            for t in range(n):
                weight[t, tags[t]] += np.exp(score)
        assert odds[:n, c] == pytest.approx(weight[:, 1] / weight[:, 0])


def test_probabilities_of_texts_of_all_lengths():
    r = np.random.default_rng(6)
    pairs = np.array([[0.5, -1.0], [-0.3, 0.8]])
    lists = [r.standard_normal(n) for n in (0, 3, 900, 70, 65, 1, 0, 64)]
    together = toxicity.probabilities(lists, pairs)
    for own, p in zip(lists, together, strict=True):
        assert len(p) == len(own)
        assert p == pytest.approx(toxicity.probabilities([own], pairs)[0])
