"""Exact search by inner product, and whitening."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logitblend.llm import products, whitening

BAD = [
    (100_000, None), (100_100, [1.0, None] + [0.0] * 6), (100_200, [float("nan")] * 8),
    (100_300, [float("inf")] * 8),
]


def table(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("rank", "x", "size", "length", "id", "score", "component", "n"):
        made = made.withColumn(name, F.lit("kept"))
    return made.repartition(3)


def floored(vector, scale):
    limit = 1 << 63
    return [min(max(math.floor(scale * c) if abs(scale * c) < 1e300 else int(math.copysign(limit, c)), -limit), limit - 1) for c in vector]


def highest(rows, every=20, top=20):
    limit = 1 << 63
    good = [(i, floored(v, 64)) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        best = {}
        for _, x in (r for r in good if r[0] == q):
            for i, y in good:
                if i != q and len(x) == len(y):
                    score = min(max(sum(a * b for a, b in zip(x, y, strict=True)), -limit), limit - 1)
                    best[i] = max(score, best.get(i, score))
        ranked = sorted((-s, i) for i, s in best.items())[:top]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return out


def vectors(n=700, d=8, seed=1):
    r = np.random.default_rng(seed)
    rows = r.standard_normal((n, d)) * r.uniform(0.1, 3, (n, 1)) * 0.7 ** np.arange(d)
    return [(i, row.tolist()) for i, row in enumerate(rows)]


@pytest.mark.parametrize("block_rows", [None, 60])
def test_products_equal_all_pairs(spark, block_rows):
    base = vectors()
    good = [
        *base,
        *[(1000 + i, base[3][1]) for i in range(300)],  # one very common vector: ties
        (2000, [1.0] * 5), (2020, [2.0] * 5), (2040, []), (2041, []), (2060, [0.0] * 8),
        (3, base[5][1]), (20, base[6][1]), (20, base[6][1]),
        (2080, [1e17] + [0.5] * 7), (2081, [-1e300] + [3.0] * 7),
    ]
    found = products.highest(table(spark, good + BAD + [(None, [1.0] * 8)]), F.col("vec_id") % 20 == 0, block_rows=block_rows)
    assert sorted(tuple(r) for r in found.collect()) == sorted(highest(good))


def test_products_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (20, [-1.0, 0.0])]
    found = products.highest(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in found.collect()) == sorted(highest(rows))
    assert products.highest(table(spark, BAD), F.col("vec_id") % 20 == 0).count() == 0
    with pytest.raises(ValueError, match="integer"):
        products.highest(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))


def test_bounds_drop_most_pairs():
    r = np.random.default_rng(5)
    turn = np.linalg.qr(r.standard_normal((32, 32)))[0]
    rows = np.floor(64 * (r.standard_normal((4000, 32)) * 0.6 ** np.arange(32)) @ turn).astype(np.int64)
    rotation = np.linalg.eigh(rows.T @ rows)[1][:, ::-1]
    block = products.Block(np.arange(4000), rows, rotation)
    queries = rows[:50]
    exact = queries @ rows.T
    exact[np.arange(50), np.arange(50)] = -(1 << 62)
    q, ids, score = block.search(np.arange(50), queries, np.full(50, -np.inf), 20)
    want = np.argsort(-exact, axis=1, kind="stable")[:, :20]
    assert (ids.reshape(50, 20) == want).all()
    assert (score == exact[q, ids]).all()
    assert block.dropped > 0.7 * exact.size


def eigen(x):
    distinct = np.unique(x, axis=0)
    n = len(distinct)
    sums = distinct.sum(axis=0)
    c = (n * distinct - sums) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    return n, sums, values[::-1], turn[:, ::-1]


def check_whitened(spark, rows, frame):
    found = whitening.whitened(frame, keep=("vec_id",)).collect()
    lists = [v for _, v in rows]
    x = np.array([floored(v, 256) for v in lists])
    n, sums, values, turn = eigen(x)
    wanted = min(4, x.shape[1])
    assert len(found) == wanted * len(rows)
    projected = ((n * x - sums) / n) @ turn[:, :wanted] / np.sqrt(values[:wanted])
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    own = {}
    for r in found:
        own.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for k, (i, _) in enumerate(rows):
        for c in range(wanted):
            for r in own[i, c + 1]:
                assert r.n == n and r.deviation == deviation[k]
                assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
                assert r.identity_error <= 1e-9
                if abs(projected[k, c]) > 1e-3:
                    signs.setdefault(c, np.sign(projected[k, c] * r.whitened))
                assert r.whitened * signs.get(c, 1) == pytest.approx(projected[k, c], abs=1e-9)


@pytest.mark.parametrize("width", [2, 8, 90])
def test_whitened_equals_an_eigendecomposition(spark, width):
    base = vectors(300, width, 3)
    rows = [*base, *[(1000 + i, base[7][1]) for i in range(200)], (5000, [0.0] * width)]
    bad = [(i, v) for i, v in BAD if v is None or len(v) != width or True]
    bad = [(i, v and ([v[0]] * (width - 1) + [None] if None in v else [v[0]] * width)) for i, v in bad]
    check_whitened(spark, rows, table(spark, rows + bad))


def test_a_flat_spectrum_is_certified(spark):
    r = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((400, 48)))]
    check_whitened(spark, rows, table(spark, rows))


def test_filter_needs_more_than_one_round():
    r = np.random.default_rng(2)
    turn = np.linalg.qr(r.standard_normal((200, 200)))[0]
    values = np.linspace(10, 1, 200)
    matrix = turn * values @ turn.T
    passes = []

    def times(q):
        passes.append(q.shape)
        return matrix @ q

    found, vectors_ = whitening.leading(times, 200, 4)
    assert len(passes) > 2 * whitening.DEGREE
    assert {shape for shape in passes} == {(200, 4 + whitening.SPARE)}
    assert np.abs(found - values[:4]).max() < 1e-12
    assert np.abs(np.abs((turn[:, :4] * vectors_).sum(axis=0)) - 1).max() < 1e-12


def test_whitening_without_variance_and_of_several_lengths(spark):
    one = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one} == {
        (i, c, 1, 0, None, 0.0) for i in (1, 2, None) for c in (1, 2)
    }
    assert {r.identity_error for r in one} == {0.0}
    line = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [5.0]), (4, [7.0]), (5, [])]
    got = {(r.vec_id, r.component): r for r in whitening.whitened(table(spark, line)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)}
    assert abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 2].whitened is None
    assert abs(got[3, 1].whitened) == pytest.approx(1) and got[3, 1].explained == pytest.approx(1)
    assert whitening.whitened(table(spark, [(100_000, None)])).count() == 0


def test_large_components_keep_exact_deviations(spark):
    rows = [(1, [1e300, 0.0]), (2, [-3e12, 1.0]), (3, [2e12, 5.0]), (4, [0.0, 0.0])]
    got = whitening.whitened(table(spark, rows)).collect()
    x = [floored(v, 256) for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    limit = (1 << 63) - 1
    want = {i: min(sum((4 * a - s) ** 2 for a, s in zip(v, sums, strict=True)), limit) for (i, _), v in zip(rows, x, strict=True)}
    assert {r.vec_id: r.deviation for r in got} == want
