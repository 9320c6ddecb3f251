"""Sharding and mixing."""

from collections import Counter, defaultdict

import brute
import pytest

from logitblend.llm import mixing, sharding


@pytest.mark.parametrize("bucket_bytes", [sharding.BUCKET_BYTES, 2000, 1])
def test_shards_hold_every_record_once(frame, bucket_bytes):
    rows = brute.corpus(3, 60) + [(5, "same", "s")] * 40
    docs = frame(rows)
    got = sharding.into_shards(docs, bucket_bytes=bucket_bytes).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    assert {r["size"] for r in got} == {"kept"}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_are_in_random_order(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(4000)], "doc_id long, text string")
    got = sharding.into_shards(docs, shards=1, bucket_bytes=1000).orderBy("slot").collect()
    ids = [r.doc_id for r in got]
    assert sorted(ids) == list(range(4000))
    follows = sum(b == a + 1 for a, b in zip(ids, ids[1:], strict=False))
    assert follows < 20
    mean = sum(abs(i - d) for i, d in enumerate(ids)) / 4000
    assert 1200 < mean < 1470  # a third of 4000 for a uniform permutation


def test_few_records(frame, tmp_path):
    assert sharding.into_shards(frame([])).count() == 0
    got = sharding.into_shards(frame([(1, None, None), (None, "a", None)])).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0)]
    sharding.write_shards(sharding.into_shards(frame(brute.corpus(0, 20))), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("shard=*"))) == 8


def plain_targets(sizes, weights=(1, 2, 3)):
    """Share by weight, again and again, until none is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("rows_per_slice", [mixing.ROWS_PER_SLICE, 5])
def test_mix_meets_targets(frame, rows_per_slice):
    rows = [(i, brute.prose(i, 1 + i * 7 % 40), f"s{min(i % 9, 4)}") for i in range(900)]
    rows += [(1000 + i, brute.prose(i, 3), None) for i in range(30)]
    rows += [(2000 + i, "", "empty") for i in range(3)] + [(3000, None, "Ä"), (3001, "a", "Ä")]
    rows += [(4000, "twice the same row", "s1")] * 2
    docs = frame(rows)
    got = mixing.mixed(docs, rows_per_slice=rows_per_slice).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(brute.SPACE.findall(text or ""))
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r["size"] == len(brute.SPACE.findall(r.text or ""))
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 80, source
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mixed(frame(rows[::-1]).repartition(5), rows_per_slice=7).collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.copies) for r in got)


def plain_mix(rows, dealt):
    """How often each row is taken, by a queue of every copy; rows (id, text, source)."""
    size = [len(brute.SPACE.findall(t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] += n
    want = plain_targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    queue = []
    for rank, s in enumerate(names):
        own = [i for i, r in enumerate(rows) if r[2] == s]
        own.sort(key=lambda i: (dealt[i], str(rows[i][0]) if rows[i][0] is not None else "", size[i], i))
        for epoch in range(3 if sizes[s] else 1):
            at = epoch * sizes[s]
            for place, i in enumerate(own):
                at += size[i]
                queue.append((at / want[s] if want[s] else 0.0, rank, epoch, place, i))
    copies, used, budget = [0] * len(rows), 0, sum(sizes.values())
    for *_, i in sorted(queue):
        if used + size[i] > budget:
            break
        used += size[i]
        copies[i] += 1
    return copies


@pytest.mark.parametrize("seed, rows_per_slice, rows_per_span", [(1, 1024, 4096), (2, 5, 3)])
def test_mix_equals_a_queue_of_every_copy(frame, spark, monkeypatch, seed, rows_per_slice, rows_per_span):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "ROWS_PER_SPAN", rows_per_span)
    rows = [(i, brute.prose(i + seed, 1 + i * 7 % 40), f"s{min(i % 9, 4)}") for i in range(300)]
    rows += [(1000 + i, brute.prose(i, 3 + seed), None) for i in range(30)]
    rows += [(i, None if i % 2 else " ", "empty") for i in range(5)]
    rows += [(7, "five words in this row", "hot")] * 150 + [(i, "one", "hot") for i in range(40)]
    dealt = [
        r.d
        for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string, source string")
        .select("k", F.xxhash64(F.lit(mixing.SEED), "doc_id", "source", "text").alias("d"))
        .orderBy("k")
        .collect()
    ]
    got = Counter()
    for r in mixing.mixed(frame(rows), rows_per_slice=rows_per_slice).collect():
        got[r.doc_id, r.text, r.source] += r.copies
    want = Counter()
    for r, n in zip(rows, plain_mix(rows, dealt), strict=True):
        want[r] += n
    assert +got == +want


def test_copies_of_one_row_are_taken_one_by_one(frame):
    """A source of one row, many times over, comes near its target, too."""
    rows = [(0, "one two three four five", "a")] * 400
    rows += [(1 + i, brute.prose(i, 10), "b") for i in range(100)]
    results = []
    for docs in (frame(rows), frame(rows[::-1]).repartition(7)):
        got = mixing.mixed(docs).collect()
        taken = Counter()
        for r in got:
            taken[r.source] += r.taken
            assert r.copies <= 3
        assert taken == {"a": 1000, "b": 2000}
        results.append(Counter((r.doc_id, r.taken) for r in got))
    assert results[0] == results[1]


def test_mix_repeats_documents(frame):
    docs = frame([(i, brute.prose(i, 10), "big" if i < 90 else "small") for i in range(100)])
    mix = mixing.mixed(docs)
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    assert {r["size"] for r in out.collect()} == {"kept"}
    assert Counter(r.doc_id for r in out.collect()) == Counter(
        {r.doc_id: r.copies for r in mix.collect() if r.copies}
    )


def test_mix_of_nothing(frame):
    assert mixing.mixed(frame([])).count() == 0
    got = mixing.mixed(frame([(1, "", None), (2, None, None)])).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2


def test_totals_before_each_place(spark):
    import random

    from logitblend.llm.common import with_total_before

    r = random.Random(4)
    data = [(g, p, r.randrange(9)) for g in (None, "a", "b") for p in r.sample(range(-9000, 20_000), 150)]
    frame = spark.createDataFrame(data, "g string, p long, w long")
    got = {(x.g, x.p): x.t for x in with_total_before(frame, "p", "w", "t", ("g",)).collect()}
    assert got == {(g, p): sum(w for h, q, w in data if h == g and q < p) for g, p, _ in data}
    alone = frame.filter("g = 'a'").drop("g")
    got = {x.p: x.t for x in with_total_before(alone, "p", "w", "t").collect()}
    assert got == {p: sum(w for h, q, w in data if h == "a" and q < p) for g, p, _ in data if g == "a"}


def test_mix_does_not_depend_on_slices(frame):
    docs = frame([(i, brute.prose(i, 1 + i % 30), f"s{i % 4}") for i in range(300)])
    results = [
        sorted((r.doc_id, r.copies) for r in mixing.mixed(docs, rows_per_slice=n).collect())
        for n in (3, 50, 10_000)
    ]
    assert results[0] == results[1] == results[2]
