"""The near-copy stage of the pipeline against brute-force Jaccard."""

import random
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from logitblend.llm import similar


def shingles(text, n=5):
    words = brute.SPACE.findall(brute.lower(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def components(texts, least=0.8):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def families(n, words=100, edits=(1, 1, 2, 2, 8)):
    """Texts, each followed by near copies: beyond 4 bits mostly, and one that is too far."""
    texts = []
    for i in range(n):
        base = brute.prose(100 + i, words, 5000)
        texts += [base, *(brute.mutated(base, 1000 * i + k, e) for k, e in enumerate(edits))]
    return texts


def test_stage_links_all_near_copies(frame):
    texts = families(40) + [None, "", " ", "one two", "One two", "one two three"]
    groups = components(texts)
    docs = frame([(i, t, "s") for i, t in enumerate(texts)])
    kept = corpus_pipeline.simhash_near_dedup(None, docs, "")
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(groups))


@pytest.mark.parametrize("shard_rows, cluster_bytes", [(similar.SHARD_ROWS, similar.CLUSTER_BYTES), (8, 30_000)])
def test_dense_group_of_near_copies(frame, shard_rows, cluster_bytes):
    base = brute.prose(1, 150, 5000)
    texts = [brute.mutated(base, k, 1 + k % 2) for k in range(150)] + families(3)
    docs = frame([(i, t, "s") for i, t in enumerate(texts)])
    kept = similar.deduplicated(docs, shard_rows=shard_rows, cluster_bytes=cluster_bytes)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(texts)))


def test_pairs_at_the_threshold_share_a_shard():
    """Of pairs just above 0.8, hardly any has no band in common, and none is beyond the radius."""
    r = np.random.default_rng(4)
    found = 0
    for _ in range(500):
        own = r.integers(0, 2**63, 210, dtype=np.uint64)
        sets = [np.sort(x) for x in (own[:190], own[20:])]  # 170 of 210: 0.81
        a, b = (similar._number(similar.sketch(x)) for x in sets)
        assert (a ^ b).bit_count() <= similar.RADIUS
        found += bool((similar.bands(sets[0]) == similar.bands(sets[1])).any())
    assert found >= 497


def test_shards_connect_all_candidates():
    r = random.Random(5)
    centres = [r.getrandbits(1024) for _ in range(12)]
    prints = [c ^ sum(1 << b for b in r.sample(range(1024), r.randrange(120))) for c in centres for _ in range(12)]
    prints += prints[:5]
    nodes = list(range(100, 100 + len(prints)))
    for some in (prints, prints[:2], prints[11:13]):
        groups = {n: n for n in nodes[: len(some)]}
        for n, first in similar.forest(nodes[: len(some)], some, 150):
            groups[n] = first
        parent = list(range(len(some)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(some)):
            for j in range(i):
                if (some[i] ^ some[j]).bit_count() <= 150:
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
        assert [groups[n] - 100 for n in nodes[: len(some)]] == [root(i) for i in range(len(some))]


def test_links_of_a_cluster_connect_all_that_are_similar():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    sets = []
    for k in range(120):
        own = base.copy()
        at = r.choice(300, r.integers(0, 60), replace=False)
        own[at] = r.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(own))
    sets += [sets[3], np.unique(base[:40])]
    nodes = np.arange(50, 50 + len(sets))
    prints = np.frombuffer(b"".join(map(similar.sketch, sets)), np.uint64).reshape(len(sets), -1)

    def groups(links):
        parent = {int(n): int(n) for n in nodes}

        def root(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for a, b in links:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        return [root(int(n)) for n in nodes]

    plain = [(int(nodes[i]), int(nodes[j])) for i in range(len(sets)) for j in range(i) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    links = similar.cluster_links(nodes, prints, sets)
    assert groups(links) == groups(plain)
    assert len(links) == len(sets) - len(set(groups(plain)))


def test_candidates_of_one_template_grow_in_proportion(frame, monkeypatch):
    """Texts of one template that are no copies by the rule are hardly ever compared, and what leaves a
    task grows with its members, not with their pairs."""
    counts, plain = [], similar._confirmed

    def counting(sets, *rest):
        found = plain(sets, *rest)
        counts[-1] += [sets.count(), found.count()]
        return found

    monkeypatch.setattr(similar, "_confirmed", counting)
    base = brute.prose(1, 150, 5000)
    for n in (200, 400):
        counts.append([])
        texts = [brute.mutated(base, 50 + k, 5) for k in range(n)]
        kept = similar.deduplicated(frame([(i, t, "s") for i, t in enumerate(texts)]))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(texts)))
    # Of 19,900 pairs, and of 79,800.
    assert counts[0][0] <= 100 and counts[1][0] <= 200 and all(links <= rows for rows, links in counts)


@pytest.mark.parametrize("shard_rows, cluster_bytes", [(similar.SHARD_ROWS, similar.CLUSTER_BYTES), (4, 12_000)])
def test_chains_and_related_groups(frame, shard_rows, cluster_bytes):
    """Groups whose members are near, one after the other, while their ends aren't."""
    texts = []
    for f in range(3):
        own = brute.prose(40 + f, 120, 5000).split(" ")
        for k in range(24):
            own = [*own[2:], f"n{f}x{k}", f"n{f}y{k}"]
            texts.append(" ".join(own))
    texts += [brute.mutated(t, k, 1) for k, t in enumerate(texts)]
    kept = similar.deduplicated(frame([(i, t, "s") for i, t in enumerate(texts)]), shard_rows=shard_rows, cluster_bytes=cluster_bytes)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(texts)))


def test_runs_over_batches():
    r = random.Random(2)
    keys = sorted(r.randrange(40) for _ in range(90))
    rows = list(enumerate(keys))
    for size in (1, 2, 7, 100):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_pylist([{"v": v, "k": k} for v, k in p]) for p in parts]
        got = [(c["k"][0], c["v"].tolist()) for c in similar._runs(iter(batches), ("k",))]
        want = [(k, [v for v, x in rows if x == k]) for k in sorted(set(keys))]
        assert got == [(k, v) for k, v in want if len(v) > 1]


def test_repeated_rows_and_rows_without_a_key(frame):
    rows = [(None, "a b c d e f g", "s"), (3, "a b c d e f g", "s"), (3, "a b c d e f g", "s"), (None, "x", "s")]
    kept = similar.deduplicated(frame(rows)).collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == [(False, rows[0][1]), (True, "x")]
    assert similar.deduplicated(frame([])).count() == 0
