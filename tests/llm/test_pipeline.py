"""Every stage of the pipeline against a plain version over its own input."""

from collections import Counter, defaultdict

import brute
import corpus_pipeline
import pytest

from test_similar import components as near_copies

import __spark_entry__ as entry
from logitblend.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def rows(table):
    return [tuple(r) for r in table.collect()]


def test_stages_keep_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns


def test_quality_keeps_good_documents(spark, stages):
    before, after = stages["quality_classifier"]
    kept = set(rows(after))
    assert kept <= set(rows(before))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    ids = {r[0] for r in kept}
    known = [(labels[r[0]], r[0] in ids) for r in rows(before) if r[0] in labels]
    assert sum(bool(q) == k for q, k in known) >= 0.95 * len(known)


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages["simhash_near_dedup"]
    own = sorted(rows(before))
    groups = near_copies([r[1] for r in own])
    assert Counter(rows(after)) == Counter(own[g] for g in set(groups))


def test_decontamination_drops_hit_documents(spark, stages):
    before, after = stages["benchmark_decontamination"]
    items = rows(spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text"))
    want = [r for r in rows(before) if not brute.contaminated(r[1], items)[-1]]
    assert Counter(rows(after)) == Counter(want)


def test_mix_takes_whole_documents_near_the_targets(stages):
    from test_order import plain_targets

    before, after = stages["source_mixing"]
    size = lambda t: len(brute.SPACE.findall(t or ""))
    assert set(rows(after)) <= set(rows(before))
    assert max(Counter(rows(after)).values()) <= 3
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before.collect():
        sizes[r.source] += size(r.text)
    for r in after.collect():
        taken[r.source] += size(r.text)
    longest = max(size(r.text) for r in before.collect())
    for source, words in plain_targets(sizes).items():
        assert abs(taken[source] - words) <= longest


def test_shards_hold_the_mix(stages):
    before, after = stages["sharding"]
    assert Counter(rows(after.select(before.columns))) == Counter(rows(before))
    slots = defaultdict(list)
    for r in after.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_run_gives_the_last_stage(spark, stages):
    _, last = stages["sharding"]
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == last.columns
    assert Counter(r[0] for r in rows(got)) == Counter(r[0] for r in rows(last))


def test_documents_without_rows(spark, stages):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0


def test_queries_are_registered():
    assert queries.QUERIES.keys() <= entry.queries().keys()
    numbers = {n.split("_")[0] for n in queries.QUERIES}
    assert numbers == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_odd_documents_go_through_all_stages(spark, frame):
    """Nulls in every column, empty and long texts, repeated rows, columns with names that
    operators use."""
    odd = brute.corpus(6, 40) + [(None, None, None), (None, "no key", None), (None, "no key", None)]
    odd += [(i, text, source) for i, text, source in brute.corpus(6, 10)]
    docs = frame(odd).drop("shard")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF_DIR)
        got = Counter(rows(after.select(before.columns)))
        have = Counter(rows(before))
        if name == "source_mixing":
            assert set(got) <= set(have) and all(n <= 3 * have[r] for r, n in got.items())
        elif name == "sharding":
            assert got == have
        else:
            assert not got - have
            assert after.columns == before.columns
        before = spark.createDataFrame(after.collect(), after.schema)
    assert {r["size"] for r in before.collect()} == {"kept"}
