"""What the plans look like, and joins under skew."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from logitblend.operators import candidates, dedup, dimensions, filling, metrics
from logitblend.plans import ensemble
from logitblend.profiles import uniform_weights
from logitblend.sources import jsonl
from logitblend.sources import logits as logit_tables
from test_blending import PROFILES, make_case, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.fixture(scope="module")
def case(spark):
    data, vocab, subtokens = make_case(11, 2, 30)
    return tables(spark, data, vocab, subtokens)


def test_top_k_is_a_projection(case):
    logits = case[0]
    plan = plan_of(candidates.top_k(logits, 5))
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert plan.count("array_max") == 1, "computed once, not again in a filter"


def test_rank_limit_runs_before_the_shuffle(spark, case):
    long = case[0].select(
        "run", "example_id", "step", "model", F.posexplode("logits").alias("token_id", "logit"))
    plan = plan_of(candidates.top_k_long(long, 5))
    assert plan.count("WindowGroupLimit") == 2 and len(shuffles(plan)) == 1
    rows = spark.createDataFrame([(1, "a")], "seq int, question string")
    assert plan_of(dedup.first_rows(rows, ["question"])).count("WindowGroupLimit") == 2


def test_blend_shuffles_candidates_and_vectors_once(case):
    plan = plan_of(ensemble.picks(*case, uniform_weights(PROFILES[:2])))
    by_step = [s for s in shuffles(plan) if "example_id" in s]
    assert len(by_step) == 2
    assert "ShuffledHashJoin" in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_blend_orders_and_normalises_without_windows(case):
    plan = plan_of(ensemble.blended(*case, uniform_weights(PROFILES[:2])))
    assert "Window" not in plan
    picks = plan_of(ensemble.picks(*case, uniform_weights(PROFILES[:2])))
    assert len(re.findall(r"\bWindow \[", picks)) == 1


def test_long_blend_moves_its_rows_once_and_never_sorts_them_for_a_join(spark, case, tmp_path):
    logits, vocab, subtokens = case
    long = logits.select(
        "run", "example_id", "step", "model", F.posexplode("logits").alias("token_id", "logit"))
    long.write.parquet(str(tmp_path / "long"))
    stored = spark.read.parquet(str(tmp_path / "long"))
    picks = ensemble.picks(stored, vocab, subtokens, uniform_weights(PROFILES[:2]))
    assert "SortMergeJoin" not in plan_of(picks)
    rows = picks.collect()
    final = plan_of(picks).split("Initial Plan")[0]
    moved = [s for s in shuffles(final) if "REPARTITION_BY_COL" in s and "ReusedExchange" not in s]
    assert len(moved) == 1 and "ReusedExchange" in final
    dense = ensemble.picks(logits, vocab, subtokens, uniform_weights(PROFILES[:2])).collect()
    assert sorted(map(str, rows)) == sorted(map(str, dense))


def test_blend_of_bucketed_logits_shuffles_nothing(spark, case, tmp_path):
    logits, vocab, subtokens = case
    profiles = uniform_weights(PROFILES[:2])
    logit_tables.write_bucketed(logits, "bucketed_logits", 4, str(tmp_path / "t"))
    stored = logit_tables.read_bucketed(spark, "bucketed_logits")
    blended = ensemble.picks(stored, vocab, subtokens, profiles, colocated=True)
    plan = plan_of(blended)
    assert not [s for s in shuffles(plan) if "example_id" in s]
    scans = re.findall(r"FileScan parquet \S*bucketed_logits\[([^\]]*)\]", plan)
    assert len(scans) == 2 and sum("logits#" in columns for columns in scans) == 1
    plain = ensemble.picks(logits, vocab, subtokens, profiles)
    assert sorted(map(str, blended.collect())) == sorted(map(str, plain.collect()))


def test_faulty_keys_are_refused(spark, case, tmp_path):
    logits = case[0]
    assert candidates.faulty_keys(logits).isEmpty()
    twice = logits.unionByName(logits.filter("step = 1 AND model = 2"))
    nameless = logits.withColumn("run", F.when(F.col("step") > 0, F.col("run")))
    assert candidates.faulty_keys(twice).select("step", "model").distinct().collect() == [(1, 2)]
    assert not candidates.faulty_keys(nameless).isEmpty()
    plan = plan_of(candidates.faulty_keys(spark.read.schema(logits.schema).parquet(str(tmp_path))))
    assert "logits" not in re.search(r"ReadSchema: (.*)", plan).group(1)
    with pytest.raises(ValueError, match="one vector per step"):
        logit_tables.write_bucketed(twice, "never_written", 2, str(tmp_path / "t"))


def test_stored_top_k_serves_smaller_k_only(spark, case, tmp_path):
    logits = case[0]
    logit_tables.write_bucketed(logits, "ranked_logits", 2, str(tmp_path / "t"), k=6)
    stored = logit_tables.read_bucketed(spark, "ranked_logits")
    assert [candidates.stored_top(stored, k) for k in (3, 6, 7)] == ["top_6", "top_6", None]
    for k in (3, 7):
        got = candidates.top_k(stored, k)
        assert sorted(map(str, got.collect())) == sorted(
            map(str, candidates.top_k(logits, k).collect()))


def test_first_values_is_hash_based(spark):
    rows = spark.createDataFrame([(1, "a", 1)], "seq int, question string, hit int")
    plan = plan_of(dedup.first_values(rows, "question", {"hit": F.col("hit")}))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_first_values_sort_short_rows(spark, tmp_path):
    """By the order of result files: once in a row for all values, and without the folder's name."""
    folder = str(tmp_path / ("long" * 20) / "r 1%")
    schema = "seq bigint, question string, pred string, label string, subject string"
    for n in range(3):
        rows = [(s, f"q{s}", "A", "AB"[n % 2], f"s{n}") for s in (7 - n, None, 5)]
        jsonl.write_results(spark.createDataFrame(rows, schema).repartition(2), folder, "append")
    back = jsonl.read_results(spark, folder, "choice")
    values = {"subject": F.col("subject"), "hit": metrics.choice_hit()}
    plan = plan_of(dedup.first_values(back, "question", values))
    assert plan.count("partial_min_by(") == 1
    short, whole = dedup.short_order(back, "order")
    both = back.select("order", short.alias("short"), whole(short).alias("whole")).collect()
    assert len(both) == 9 and all(r["order"] == r["whole"] for r in both)
    assert max(len(r["short"]["at"]["file"]) for r in both) < 100 < min(len(r["order"]["at"]["file"]) for r in both)
    got = dedup.first_values(back, "question", values, keep_order=True)
    assert got.columns == [*dedup.KEY, "subject", "hit", "_order"]
    orders = {tuple(r["order"]["at"]) for r in both}
    assert all(not r["_order"]["none"] and tuple(r["_order"]["value"]["at"]) in orders for r in got.collect())
    first = dedup.first_values(back, "question", values).collect()
    assert sorted(map(tuple, first)) == [("s0", True)] * 3 + [("s1", False)]


def test_short_orders_sort_as_whole_ones(spark, tmp_path):
    """Names with the common beginning, and names before, behind and inside it, as of rows that were stored."""
    for name in ("a1", "a2", "b1"):
        (tmp_path / name).write_text('{"question": "q"}\n')
    rows = jsonl.read_items(spark, str(tmp_path), "question string")
    files = sorted(r["seq"]["file"] for r in rows.collect())
    start = files[0][:-2]
    made = [*files, start, start[:-1], start + "0", start[:-1] + "~", start[:-1] + "!", "", "zz", None, start + "é"]
    mixed = rows.limit(1).select(F.explode(F.array(*map(F.lit, made))).alias("file")).select(
        F.struct(F.lit(5).alias("n"), F.struct("file", F.lit(0).alias("start")).alias("at")).alias("order"))
    short, whole = dedup.short_order(mixed, "order")
    both = mixed.select("order", short.alias("short")).withColumn("whole", whole(F.col("short")))
    assert any(r["short"]["at"]["file"] == "1a1" for r in both.collect()), "the folder is left out"
    assert both.filter("order <=> whole").count() == len(made)
    names = [[r["order"]["at"]["file"] for r in both.orderBy(c).collect()] for c in ("order", "short")]
    assert names[0] == names[1] and len(set(names[0])) == len(made)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_broadcast_join(spark, how):
    """A third of the rows share one key, and the lookup table counts as large."""
    facts = spark.range(3000).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("k"))
    table = spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    small, large = dimensions.dimension(table), dimensions.dimension(table, max_bytes=10)
    assert small.small and not large.small
    joined = dimensions.join_dimension(facts, large, ["k"], how)
    assert "BroadcastHashJoin" in plan_of(dimensions.join_dimension(facts, small, ["k"], how))
    assert "_salt" in plan_of(joined)
    expected = dimensions.join_dimension(facts, small, ["k"], how).select(joined.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, expected.collect()))


def test_salts_spread_a_hot_key_and_even_its_copies(spark):
    """Rows that differ get many salts; equal rows get those of their partitions."""
    rows = spark.range(0, 4000, 1, 16).select(F.col("id").alias("n"), F.lit(7).alias("k"))
    assert rows.select(dimensions.salt(["n"]).alias("s")).distinct().count() == dimensions.SALTS
    copies = rows.select(dimensions.salt(["k"]).alias("s"))
    assert copies.distinct().count() == 16
    first = sorted(r["s"] for r in copies.collect())
    assert first == sorted(r["s"] for r in copies.collect()), "the same when run again"


def test_rows_without_a_key_are_spread_and_kept(spark):
    facts = spark.range(5000).select(
        F.col("id").alias("n"), F.when(F.col("id") < 10, F.col("id")).alias("k"))
    table = spark.range(20).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    large = dimensions.Dimension(table, False)
    joined = dimensions.join_dimension(facts, large, ["k"], "left")
    assert joined.count() == 5000 and joined.filter("v IS NOT NULL").count() == 10
    assert dimensions.join_dimension(facts, large, ["k"], "inner").count() == 10
    salts = facts.filter("k IS NULL").select(dimensions.salt(["n"], ["k"]).alias("s"))
    assert salts.distinct().count() > 4900 and salts.agg(F.max("s")).first()[0] < 0


def test_blend_with_large_lookup_tables(spark, case):
    logits, vocab, subtokens = case
    profiles = uniform_weights(PROFILES[:2])
    large = [dimensions.Dimension(t, False) for t in (vocab, subtokens)]
    got = ensemble.picks(logits, *large, profiles)
    expected = ensemble.picks(logits, vocab, subtokens, profiles).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_measuring_counts_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("é"), 500).alias("s"))
    tables = [spark.range(0), spark.range(10), wide]
    flags = [[d.small for d in dimensions.dimensions(*tables, max_bytes=b)] for b in (0, 1000, 100_000)]
    assert flags == [[True, False, False], [True, True, False], [True, True, True]]


def test_blank_skip_changes_the_fallback(spark):
    subtokens = spark.createDataFrame(
        [(1, "t", 0, 5), (1, "t", 1, 8), (2, "t", 0, 6), (2, "t", 1, 9)],
        "model int, token string, pos int, token_id int")

    def chosen(profiles):
        return {r["model"]: r["subtoken_id"]
                for r in filling.first_subtokens(subtokens, profiles).collect()}

    literal = [replace(p, blank_skip=False) for p in PROFILES]
    assert chosen(PROFILES) == {1: 8, 2: 9}
    assert chosen(literal) == {1: 5, 2: 6}
