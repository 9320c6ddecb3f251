"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from brute import corpus, lower, prose

from logitblend.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, top=10):
    own = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, length = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        wanted = set(TERM.findall(lower(text)))
        scored = []
        for doc, c, n in own:
            m = 100 - 90 + (90 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in wanted
                if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return out


def items_of(n=30):
    rows = [(f"i{k}", prose(k, 3 + k) + (" Ünï CODE_x1" if k % 5 == 0 else "")) for k in range(n)]
    return [*rows, ("none", None), ("empty", " .,"), ("far", "nowhere"), (None, prose(3, 5)), rows[4], ("i4", "w1 be")]


def key(row):
    return tuple((v is None, v if v is not None else 0) if k != 0 else str(v) for k, v in enumerate(row))


@pytest.mark.parametrize("tile, block", [(512, 1 << 20), (7, 900)])
def test_every_item_equals_all_pairs(spark, frame, monkeypatch, tile, block):
    rows = [*corpus(3, 120), (None, prose(4, 40), "s"), (40, prose(4, 40), "s"), (40, prose(4, 40), "s")]
    items = items_of()
    if tile == 7:
        # One task, as the workers don't see what is patched here.
        monkeypatch.setattr(ranking, "TILE_TERMS", 5)
    docs = frame(rows).withColumnRenamed("size", "rank")
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = [tuple(r) for r in ranking.ranked(docs, bench, block_bytes=block).collect()]
    want = ranked([(i, t) for i, t, _ in rows], items)
    assert sorted(found, key=key) == sorted(want, key=key)


def test_ties_at_the_last_place_go_to_smaller_ids(spark, frame):
    rows = [(1000 - i, "alpha beta " + "gamma " * (i % 2), "s") for i in range(400)] + [(5000, "delta", "s")] * 900
    items = [("a", "alpha"), ("b", "beta gamma alpha")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = sorted(tuple(r) for r in ranking.ranked(frame(rows), bench).collect())
    assert found == sorted(ranked([(i, t) for i, t, _ in rows], items))
    assert found[0][2] == 602


def test_empty_tables(spark, frame):
    bench = spark.createDataFrame([("a", "alpha")], "item_id string, text string")
    assert ranking.ranked(frame([], extra=True).limit(0), bench).count() == 0
    assert ranking.ranked(frame([(1, None, "s"), (2, "", "s")]), bench).count() == 0
    assert ranking.ranked(frame([(1, "alpha", "s")]), bench.limit(0)).count() == 0


def test_pieces_of_a_long_text(monkeypatch):
    text = prose(1, 5000, 50) + " " + "x" * 400 + " " + prose(2, 300, 50)
    vocabulary = {t.encode(): i for i, t in enumerate(["w1", "w7", "x" * 400, "w49"])}
    whole = ranking.counted(text, vocabulary)
    monkeypatch.setattr(ranking, "PIECE", 97)
    cut = ranking.counted(text, vocabulary)
    assert whole[0] == cut[0] == 5301
    assert (whole[1] == cut[1]).all() and (whole[2] == cut[2]).all()


@pytest.mark.parametrize("width", [3, 4096])
def test_tiles_are_exact(monkeypatch, width):
    monkeypatch.setattr(ranking, "TILE_TERMS", width)
    r = np.random.default_rng(1)
    item, term = np.nonzero(r.random((40, 300)) < 0.2)
    weights = r.integers(0, 1 << 27, 300)
    items = ranking.Items(40, item, term, weights[term])
    doc, own = np.nonzero(r.random((30, 320)) < 0.3)
    impact = r.integers(1, ranking.IMPACT, len(doc))
    got = items.scores(doc, own, impact, 30)
    want = [[0] * 30 for _ in range(40)]
    table = {}
    for i, t in zip(item.tolist(), term.tolist(), strict=True):
        table.setdefault(t, []).append((i, int(weights[t])))
    for d, t, v in zip(doc.tolist(), own.tolist(), impact.tolist(), strict=True):
        for i, w in table.get(t, ()):
            want[i][d] += w * v
    assert got.tolist() == want
