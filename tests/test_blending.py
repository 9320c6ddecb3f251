"""The blend against a plain Python model of it, and the plans Spark makes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logitblend.functions import half, vectors
from logitblend.operators import blending, candidates, filling, sequences
from logitblend.plans import ensemble
from logitblend.profiles import ModelProfile, profile_for_kind, two_model_weights, uniform_weights
from logitblend.schemas import DENSE_LOGITS, SUBTOKENS, VOCAB
from logitblend.sources import logits as logit_tables

SPACE, UNDER = "Ġ", "▁"


def spelled(token):
    return token.replace(UNDER, SPACE).replace("<0x0A>", "/n").replace("Ċ", "/n")


def best_ids(vector, k):
    return sorted(range(len(vector)), key=lambda i: (-vector[i], i))[:k]


def model_of_step(vectors_by_model, vocab, subtokens, profiles, k):
    """Per model a list of (token, score, id, source) in set order."""
    own = {}
    for m, vector in vectors_by_model.items():
        merged = {}
        for i in best_ids(vector, k):
            merged[spelled(vocab[m][i])] = (vector[i], i)
        own[m] = merged
    union = sorted({t for merged in own.values() for t in merged}, key=lambda t: t.encode())
    sets = {}
    for p in profiles:
        m = p.model
        if m not in vectors_by_model:
            continue
        vector = vectors_by_model[m]
        rows = [(t, s, i, "own") for t, (s, i) in own[m].items()]
        taken = {i for _, _, i, _ in rows}
        for t in union:
            if t in own[m]:
                continue
            key = t.replace(SPACE, p.marker) if p.marker else t
            found, source = None, "unresolved"
            if t == "":
                found, source = p.blank_id, "blank" if p.blank_id is not None else source
            elif key in vocab[m] and vocab[m].index(key) != 0:
                found, source = vocab[m].index(key), "vocab"
            else:
                pieces = [
                    i for i in subtokens[m].get(key, []) if not (p.blank_skip and i == p.blank_id)
                ]
                if pieces:
                    found, source = pieces[0], "subtoken"
            score = None if found is None else vector[found]
            if p.dedup_ids and found is not None:
                score = 0.0 if found in taken else score
                taken.add(found)
            rows.append((t, score, found, source))
        sets[m] = rows
    return sets


def blend_of_step(sets, profiles):
    mean, place, ids = {}, {}, {}
    for p in profiles:
        rows = sets.get(p.model, [])
        top = max((s for _, s, _, _ in rows if s is not None), default=0.0)
        weights = [0.0 if s is None else math.exp(s - top) for _, s, _, _ in rows]
        total = math.fsum(weights)
        for n, ((t, _, i, _), w) in enumerate(zip(rows, weights)):
            mean[t] = mean.get(t, 0.0) + p.weight * w / total
            ids.setdefault(t, {})[p.model] = i
            if p is profiles[0]:
                place[t] = n
    pick = min(mean, key=lambda t: (-round(mean[t], 12), place.get(t, 10**9), t.encode()))
    return mean, pick, ids


PROFILES = [
    ModelProfile(1, "a", blank_id=5, dedup_ids=True),
    ModelProfile(2, "b", marker=UNDER, blank_id=6, dedup_ids=False),
    ModelProfile(3, "c", blank_id=None, dedup_ids=True, blank_skip=False),
]


def make_case(seed, n, size, steps=12, levels=None):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(size + size // 2)]
    vocab, subtokens = {}, {}
    for m in range(1, n + 1):
        marker = UNDER if m == 2 else SPACE
        tokens = [w if int(w[1:]) % 3 else marker + w for w in rng.sample(words, size)]
        tokens[1] = "<0x0A>" if m == 2 else "Ċ"
        if m == 1:
            tokens[2] = ""
        if m == 2:  # two spellings of one token
            tokens[3], tokens[4] = SPACE + "twin", UNDER + "twin"
        vocab[m] = tokens
        subtokens[m] = {}
        for w in words + ["/n"]:
            for key in {w, marker + w}:
                if rng.random() < 0.8:
                    lead = [PROFILES[m - 1].blank_id or 0] if rng.random() < 0.5 else []
                    subtokens[m][key] = lead + rng.sample(range(size), 2)
    data = {}
    for s in range(steps):
        for m in range(1, n + 1):
            draw = (lambda: float(rng.choice(levels))) if levels else (lambda: rng.uniform(-4, 4))
            data[("r", s // 4, s % 4, m)] = [draw() for _ in range(size)]
    return data, vocab, subtokens


def tables(spark, data, vocab, subtokens):
    logits = spark.createDataFrame(
        [(*key, vector) for key, vector in data.items()],
        DENSE_LOGITS.replace("array<float>", "array<double>"),
    )
    v = spark.createDataFrame(
        [(m, i, t) for m, tokens in vocab.items() for i, t in enumerate(tokens)], VOCAB
    )
    s = spark.createDataFrame(
        [(m, t, p, i) for m, d in subtokens.items() for t, ids in d.items()
         for p, i in enumerate(ids)],
        SUBTOKENS,
    )
    return logits, v, s


def as_long(logits):
    return logits.select(
        "run", "example_id", "step", "model", F.posexplode("logits").alias("token_id", "logit")
    )


CASES = [(1, 2, 30, None), (2, 3, 40, None), (3, 2, 12, (0, 1, 2)), (4, 1, 20, None)]


@pytest.mark.parametrize("seed, n, size, levels", CASES)
def test_sets_means_and_picks(spark, seed, n, size, levels):
    data, vocab, subtokens = make_case(seed, n, size, levels=levels)
    profiles = uniform_weights(PROFILES[:n])
    inputs = tables(spark, data, vocab, subtokens)
    sets = ensemble.filled_sets(*inputs, profiles, k=5).collect()
    means = ensemble.blended(*inputs, profiles, k=5).collect()
    picks = ensemble.picks(*inputs, profiles, k=5).collect()
    seen = set()
    for s in range(12):
        key = (s // 4, s % 4)
        expected = model_of_step(
            {m: data[("r", *key, m)] for m in range(1, n + 1)}, vocab, subtokens, profiles, 5
        )
        got = {}
        for r in sets:
            if (r["example_id"], r["step"]) == key:
                got.setdefault(r["model"], []).append(r)
        for m, rows in expected.items():
            mine = sorted(got[m], key=lambda r: r["pos"])
            assert [(r["token"], r["score"], r["token_id"], r["source"]) for r in mine] == rows
            seen |= {r["source"] for r in mine} | {"repeated" for r in mine if r["repeated"]}
        mean, pick, ids = blend_of_step(expected, profiles)
        mine = {r["token"]: r for r in means if (r["example_id"], r["step"]) == key}
        assert mine.keys() == mean.keys()
        assert all(abs(mine[t]["p"] - p) < 1e-9 for t, p in mean.items())
        assert abs(sum(r["p"] for r in mine.values()) - 1) < 1e-9
        (chosen,) = [r for r in picks if (r["example_id"], r["step"]) == key]
        assert chosen["token"] == pick
        assert [chosen[f"token_id_{m}"] for m in range(1, n + 1)] == [
            ids[pick][m] for m in range(1, n + 1)
        ]
        first = ids[pick][1]
        assert chosen["next_token"] == (None if first is None else vocab[1][first])
    if n > 1 and levels is None:
        assert {"own", "vocab", "subtoken"} <= seen
    if n == 3:
        assert {"repeated", "unresolved"} <= seen


def test_dense_and_long_logits_agree(spark):
    data, vocab, subtokens = make_case(5, 3, 30)
    profiles = uniform_weights(PROFILES)
    logits, v, s = tables(spark, data, vocab, subtokens)
    dense = ensemble.filled_sets(logits, v, s, profiles)
    long = ensemble.filled_sets(as_long(logits), v, s, profiles)
    assert sorted(map(str, dense.collect())) == sorted(
        map(str, long.select(dense.columns).collect())
    )


def test_repeated_vectors_are_refused(spark):
    data, vocab, subtokens = make_case(6, 2, 30, steps=4)
    logits, v, s = tables(spark, data, vocab, subtokens)
    again = logits.unionAll(logits.filter("step = 1 and model = 2"))
    for table in (again, as_long(again)):
        with pytest.raises(Exception, match="more than one vector per step and model: r 0 1 2"):
            ensemble.picks(table, v, s, uniform_weights(PROFILES[:2])).collect()


def test_ids_without_a_token_stay_candidates(spark):
    data, vocab, subtokens = make_case(6, 2, 30, steps=4)
    data = {k: [*x, 9.0 if k[3] == 1 else -9.0] for k, x in data.items()}  # id 30 is not listed
    logits, v, s = tables(spark, data, vocab, subtokens)
    for table in (logits, as_long(logits)):
        sets = ensemble.filled_sets(table, v, s, uniform_weights(PROFILES[:2]), k=5).collect()
        first = [r for r in sets if r["model"] == 1 and r["pos"] == 1]
        assert {(r["token"], r["token_id"], r["source"]) for r in first} == {
            ("<unnamed 1:30>", 30, "unnamed")}
        other = [r for r in sets if r["model"] == 2 and r["token"] == "<unnamed 1:30>"]
        assert {(r["source"], r["score"], r["p"]) for r in other} == {("unresolved", None, 0.0)}
        picked = ensemble.picks(table, v, s, uniform_weights(PROFILES[:2])).collect()
        assert {(r["token"], r["next_token"], r["unnamed"]) for r in picked} == {
            ("<unnamed 1:30>", None, True)}


def test_a_step_without_any_score_of_a_model(spark):
    data, vocab, subtokens = make_case(6, 2, 30, steps=4)
    data[("r", 0, 2, 2)] = []
    logits, v, s = tables(spark, data, vocab, subtokens)
    profiles = uniform_weights(PROFILES[:2])
    sets = ensemble.filled_sets(logits, v, s, profiles).filter("step = 2 and model = 2").collect()
    assert {r["p"] for r in sets} == {0.0} and not any(r["scored"] for r in sets)
    assert {r["source"] for r in sets} <= {"out_of_range", "unresolved"}
    rows = ensemble.picks(logits, v, s, profiles).collect()
    assert {r["step"]: r["n_models"] for r in rows} == {0: 2, 1: 2, 2: 1, 3: 2}


def test_a_model_without_a_logged_vector_is_left_out(spark):
    data, vocab, subtokens = make_case(6, 2, 30, steps=4)
    del data[("r", 0, 2, 2)]
    logits, v, s = tables(spark, data, vocab, subtokens)
    for table in (logits, as_long(logits)):
        rows = ensemble.picks(table, v, s, uniform_weights(PROFILES[:2])).collect()
        assert {r["step"]: r["n_models"] for r in rows} == {0: 2, 1: 2, 2: 1, 3: 2}


def test_result_does_not_depend_on_order_or_partitions(spark):
    data, vocab, subtokens = make_case(7, 3, 30, levels=(0, 1, 2))
    profiles = uniform_weights(PROFILES)
    logits, v, s = tables(spark, data, vocab, subtokens)
    base = sorted(map(str, ensemble.picks(logits, v, s, profiles).collect()))
    shuffled = logits.repartition(7).orderBy(F.rand(3))
    assert sorted(map(str, ensemble.picks(shuffled, v, s, profiles).collect())) == base


def test_weights(spark):
    first, second = two_model_weights(PROFILES[:2], 0.25)
    assert (first.weight, second.weight) == (0.25, 0.75)
    rows = [("r", 0, 0, 1, "a", 1, 0.8, 3), ("r", 0, 0, 2, "a", 1, 0.4, 9),
            ("r", 0, 0, 1, "b", 2, 0.2, 4), ("r", 0, 0, 2, "b", 2, 0.6, 8)]
    sets = spark.createDataFrame(
        rows, "run string, example_id bigint, step int, model int, token string, pos int, "
        "p double, token_id int")
    mean = {r["token"]: r["p"] for r in blending.blend(sets, [first, second]).collect()}
    assert mean == {"a": pytest.approx(0.5), "b": pytest.approx(0.5)}
    chosen = blending.pick(blending.blend(sets, [first, second])).collect()
    assert len(chosen) == 1


def test_a_tie_goes_to_the_first_models_order(spark):
    rows = [("r", 0, 0, m, t, pos, 0.25, pos) for m, order in ((1, "zyab"), (2, "abyz"))
            for pos, t in enumerate(order, 1)]
    sets = spark.createDataFrame(
        rows, "run string, example_id bigint, step int, model int, token string, pos int, "
        "p double, token_id int")
    chosen = blending.pick(blending.blend(sets, uniform_weights(PROFILES[:2]))).collect()
    assert [r["token"] for r in chosen] == ["z"]


def test_drop_tokens_is_strict(spark):
    rows = [("r", 0, 0, m, t, s) for m in (1, 2)
            for t, s in (("a", 0.5), ("b", 0.1 if m == 1 else 0.9))]
    sets = spark.createDataFrame(
        rows, "run string, example_id bigint, step int, model int, token string, score double")
    kept = blending.drop_tokens(sets, 0.1)
    assert sorted((r["model"], r["token"]) for r in kept.collect()) == [(1, "a"), (2, "a")]
    assert blending.drop_tokens(sets, 0.5).count() == 0


def test_merged_spellings_keep_first_place_and_last_score(spark):
    rows = [("r", 0, 0, 1, "Ġa", 1, 9.0, 4), ("r", 0, 0, 1, "Ġa", 2, 8.0, 7),
            ("r", 0, 0, 1, "b", 3, 7.0, 1)]
    ranked = spark.createDataFrame(
        rows, "run string, example_id bigint, step int, model int, token string, pos int, "
        "score double, token_id int")
    got = {r["token"]: (r["pos"], r["score"], r["token_id"])
           for r in candidates.merge_spellings(ranked).collect()}
    assert got == {"Ġa": (1, 8.0, 7), "b": (3, 7.0, 1)}


def test_normalised_vocabulary_finds_newline(spark):
    vocab = spark.createDataFrame([(1, 1, "Ċ"), (1, 2, "<0x0A>"), (1, 0, "zero")], VOCAB)
    plain = {r["lookup"]: r["vocab_id"] for r in filling.vocab_lookup(vocab).collect()}
    common = {r["token"]: r["vocab_id"] for r in filling.vocab_lookup(vocab, True).collect()}
    assert plain == {"Ċ": 1, "<0x0A>": 2} and common == {"/n": 1}


@pytest.mark.parametrize("size, k", [(1, 10), (5, 10), (64, 10), (700, 10), (5000, 3), (3000, 40)])
def test_top_k_equals_sorting(spark, size, k):
    rng = random.Random(size)
    lists = [[rng.gauss(0, 3) for _ in range(size)],
             [float(rng.randint(0, 3)) for _ in range(size)],
             [float(i) for i in range(size)], [-float(i) for i in range(size)], [1.5] * size]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, logits array<double>")
    for r in rows.select("i", vectors.top_k(F.col("logits"), k).alias("top")).collect():
        want = best_ids(lists[r["i"]], k)
        assert [e["token_id"] for e in r["top"]] == want
        assert [e["pos"] for e in r["top"]] == list(range(1, len(want) + 1))
        assert [e["score"] for e in r["top"]] == [lists[r["i"]][i] for i in want]


def test_top_k_of_odd_vectors(spark):
    rows = spark.createDataFrame(
        [(0, []), (1, None), (2, [None, 2.0, None]), (3, [1.0, math.nan, 2.0]), (4, [-0.0, 0.0])],
        "i int, logits array<double>")
    got = {r["i"]: r["top"] and [e["token_id"] for e in r["top"]]
           for r in rows.select("i", vectors.top_k(F.col("logits"), 2).alias("top")).collect()}
    assert not got[0] and not got[1]
    assert got[2] == [1] and got[3] == [1, 2] and got[4] == [0, 1]


def test_softmax_and_confidence(spark):
    row = spark.createDataFrame([([1000.0, 1001.0, -1000.0],)], "v array<double>").select(
        vectors.softmax(F.col("v")).alias("p"), vectors.confidence(F.col("v")).alias("c")).first()
    assert row["p"] == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e), 0.0])
    assert row["c"] == pytest.approx(math.e / (1 + math.e))


def test_profiles_of_model_kinds():
    assert profile_for_kind(1, "llama3.1").blank_id == 220
    assert profile_for_kind(1, "llama3.1").dedup_ids
    llama2 = profile_for_kind(1, "llama2")
    assert (llama2.marker, llama2.blank_id, llama2.dedup_ids) == (UNDER, 29871, False)
    assert profile_for_kind(1, "llama2-chat").marker is None
    assert profile_for_kind(1, "chatglm").blank_id == 128
    sweep = profile_for_kind(1, "openchat", subject_sweep=True)
    assert (sweep.marker, sweep.blank_id, sweep.dedup_ids) == (None, None, False)
    literal = [profile_for_kind(1, k, literal_blank_skip=True).blank_skip
               for k in ("llama2", "openchat")]
    assert literal == [False, True]
    assert profile_for_kind(1, "deepseek", subject_sweep=True, literal_blank_skip=True).blank_skip


def test_assembled_text_and_padding(spark):
    picks = spark.createDataFrame(
        [("r", 1, 1, "▁there", 8), ("r", 1, 0, "Hi", 7), ("r", 1, 2, "<0x0A>", 13),
         ("r", 1, 3, "Ġ!", 0)],
        "run string, example_id bigint, step int, next_token string, token_id_1 int")
    row = sequences.assemble(picks).first()
    assert (row["token_ids"], row["text"], row["n_steps"]) == ([7, 8, 13, 0], "Hi there !", 4)
    batches = spark.createDataFrame(
        [(1, [1, 2, 3]), (1, [4]), (1, []), (2, [5])], "batch_id int, ids array<int>")
    rows = sorted((r["batch_id"], r["padded"], r["mask"])
                  for r in sequences.left_pad(batches, pad_id=9).collect())
    assert rows == [(1, [1, 2, 3], [1, 1, 1]), (1, [9, 9, 4], [0, 0, 1]),
                    (1, [9, 9, 9], [0, 0, 0]), (2, [5], [1])]


def test_any_steps_are_assembled(spark):
    picks = spark.createDataFrame(
        [("r", 1, s, t, i) for i, (s, t) in enumerate([(1 << 40, "c"), (-1, "a"), (0, "b")])],
        "run string, example_id bigint, step bigint, next_token string, token_id_1 int")
    row = sequences.assemble(picks).first()
    assert (row["text"], row["token_ids"]) == ("abc", [1, 2, 0])


def test_tokens_are_text_in_their_own_spelling(spark):
    tokens = ["See", "Ġ/node", "/news", "Ċ", "▁x", "<0x0A>", "</s>"]
    picks = spark.createDataFrame(
        [("r", 1, i, t, i, t == "</s>") for i, t in enumerate(tokens)],
        "run string, example_id bigint, step int, next_token string, token_id_1 int, special boolean")
    row = sequences.assemble(picks).first()
    assert row["text"] == "See /node/news x" and row["token_ids"] == list(range(7))


def test_padding_starts_no_job(spark):
    batches = spark.createDataFrame([(1, [1]), (1, [1, 2])], "batch_id int, ids array<int>")
    spark.sparkContext.setJobGroup("pad", "pad")
    sequences.left_pad(batches)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("pad")
    spark.sparkContext._jsc.clearJobGroup()


def test_vectors_that_overflowed_have_no_say(spark):
    endless, nan = float("inf"), float("nan")
    sets = [
        (1, "a", 1, 2.0), (1, "b", 2, 1.0), (2, "a", 1, nan), (2, "b", 2, 5.0),
        (3, "a", 1, endless), (3, "b", 2, 5.0), (4, "a", 1, -endless), (4, "b", 2, -endless),
        (5, "a", 1, -endless), (5, "b", 2, 3.0),
    ]
    rows = spark.createDataFrame(sets, "model int, token string, pos int, score double")
    entries = rows.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("token", "pos", "score"))).alias("e"))
    got = {r.model: r.e for r in entries.select("model", blending.with_probabilities(F.col("e")).alias("e")).collect()}
    assert {m: (e[0].scored, e[0].faulty) for m, e in got.items()} == {
        1: (True, False), 2: (False, True), 3: (False, True), 4: (False, True), 5: (True, False)}
    assert [x.p for m in (2, 3, 4) for x in got[m]] == [0.0] * 6
    assert [x.p for x in got[5]] == [0.0, 1.0]


def test_half_precision_equals_numpy(spark):
    import numpy as np

    r = np.random.default_rng(1)
    every = np.arange(1 << 16, dtype=np.uint16).view(np.float16)
    numbers = [
        every.astype(np.float64), r.standard_normal(3000) * 10.0 ** r.integers(-9, 6, 3000),
        np.array([0.0, -0.0, 65519.9, 65520.0, -1e30, 2.0**-24, 2.0**-25, 1.5 * 2.0**-24, 2048.5, 2049.5, 2.0**-14]),
        np.array([]),
    ]
    rows = spark.createDataFrame([(i, n.tolist()) for i, n in enumerate(numbers)], "i int, x array<double>")
    got = rows.withColumn("packed", half.packed(F.col("x"))).withColumn("back", half.decoded(F.col("packed")))
    for row in got.collect():
        with np.errstate(over="ignore"):
            want = numbers[row.i].astype(np.float16)
        back = np.array(row.back, np.float32)
        assert len(row.packed) == 2 * len(want)
        assert np.array_equal(back, want.astype(np.float32), equal_nan=True)
    one = got.filter("i = 1").select(
        "back", F.transform(F.sequence(F.lit(-1), F.lit(3001)), lambda k: half.entry(F.col("packed"), k)).alias("each")
    ).first()
    assert one.each == [None, *one.back, None, None]
    assert got.select(half.entry(F.lit(None).cast("binary"), F.lit(0)).alias("x")).first().x is None


@pytest.mark.parametrize("bucketed", [False, True])
def test_packed_vectors_give_the_same_picks(spark, tmp_path, bucketed):
    # Numbers that half precision holds.
    data, vocab, subtokens = make_case(5, 2, 40, levels=[x / 8 for x in range(-40, 40)])
    logits, *lookups = tables(spark, data, vocab, subtokens)
    profiles = uniform_weights(PROFILES[:2])
    short = logits.withColumn("logits", half.packed(F.col("logits")))
    if bucketed:
        logit_tables.write_bucketed(short, "packed_logits", 2, str(tmp_path / "packed"))
        short = spark.table("packed_logits")
    got, want = (
        {tuple(r) for r in ensemble.picks(t, *lookups, profiles, k=5).collect()} for t in (short, logits)
    )
    assert got == want and len(got) == 12
