import brute
import pytest
from pyspark.sql import functions as F

from logitblend.llm import simhash


def result(found):
    rows = found.select("row.doc_id", "fp", "component", "first").collect()
    return rows, sorted(((r.doc_id is None, r.doc_id or 0), r.fp, r.component) for r in rows)


def expected(rows):
    prints = [(d, brute.simhash(t)) for d, t, *_ in rows]
    signed = [p - (1 << 64) if p >> 63 else p for _, p in prints]
    return sorted(
        ((d is None, d or 0), p, c)
        for (d, _), p, c in zip(prints, signed, brute.components(prints), strict=True)
    )


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_components_equal_all_pairs(frame, shard_rows):
    rows = brute.corpus(1, 80)
    rows += rows[:5] + [(None, "", "s1"), (None, "only here are these words", "s1")]
    rows, got = result(simhash.near_duplicates(frame(rows), keep=("doc_id",), shard_rows=shard_rows)), rows
    found, values = rows
    assert values == expected(got)
    firsts = [r.component for r in found if r.first]
    assert len(firsts) == len(set(firsts)) == len({r.component for r in found})


def test_tree_links_dense_groups():
    """Prints close to each other, where most subtrees are skipped."""
    import random

    r = random.Random(3)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 300:
        p = r.choice([base, r.getrandbits(64), *list(prints)[:5]])
        for _ in range(r.randrange(7)):
            p ^= 1 << r.randrange(64)
        prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    least = dict(simhash.forest(signed, 4))
    want = brute.components([(s, s & (1 << 64) - 1) for s in signed])
    assert [least.get(s, s) for s in signed] == want


def test_every_near_pair_meets_in_a_shard():
    import random

    r = random.Random(5)
    masks = [m & (1 << 64) - 1 for _, m in simhash._shards(4, 6)]
    assert len(masks) == 15
    for _ in range(2000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_long_chains_are_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(edges).collect()
    assert {r.node: r.component for r in got} == dict.fromkeys(range(1, 201), 0)


def test_no_documents(frame):
    assert simhash.near_duplicates(frame([])).count() == 0
