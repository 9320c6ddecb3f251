"""Nearest neighbours and licences."""

import math
import random
import re
import textwrap
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from logitblend.llm import licences, neighbours
from logitblend.llm.licence_texts import NAMES, TEXTS


def nearest(rows, asked, k=10):
    """rows: (id, vector); exact answer."""
    out = []
    for q in sorted({i for i, _ in rows if i in asked}):
        best = {}
        for _, v in (r for r in rows if r[0] == q):
            for i, w in rows:
                if i != q and len(w) == len(v):
                    d = math.dist(v, w)
                    best[i] = min(d, best.get(i, d))
        ranked = sorted((d, i) for i, d in best.items())[:k]
        out += [(q, n + 1, i, pytest.approx(d)) for n, (d, i) in enumerate(ranked)]
    return out


def vectors(n=700, d=8, seed=1):
    r = np.random.default_rng(seed)
    base = [(i, r.standard_normal(d).tolist()) for i in range(n)]
    base += [(1000 + i, base[3][1]) for i in range(60)]  # one very common vector
    return base


@pytest.mark.parametrize("shard_rows, query_rows", [(5000, 2000), (150, 3)])
def test_small_shards_find_the_nearest(spark, shard_rows, query_rows):
    good = [*vectors(), (2000, [1.0] * 5), (2100, [2.0] * 5), (3, vectors()[3][1])]
    bad = [
        (100_000, None), (100_100, []), (100_200, [0.0] * 8), (100_300, [1.0, None] + [0.0] * 6),
        (100_400, [float("nan")] * 8), (100_500, [float("inf")] * 8), (None, [1.0] * 8),
    ]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    found = neighbours.neighbours(table, F.col("vec_id") % 100 == 0, shard_rows=shard_rows, query_rows=query_rows)
    got = sorted(tuple(r) for r in found.collect())
    want = nearest(good, {i for i, _ in good if i % 100 == 0})
    assert len(got) == len(want)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.98 * len(want)


def test_large_and_small_numbers_are_found(spark):
    """One vector far away spoils no search, and few candidates are all returned."""
    rows = [(0, [1.0, 2.0]), (2, [1.0, 2.5]), (1, [3e19, 1.0]), (100, [5e19, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.neighbours(table, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == [
        (0, 1, 2, 0.5), (0, 2, 1, 3e19), (0, 3, 100, 5e19),
        (100, 1, 1, 2e19), (100, 2, 0, 5e19), (100, 3, 2, 5e19),
    ]
    r = np.random.default_rng(7)
    good = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((400, 6)))]
    good += [(1000 + i, (v * 10.0 ** r.integers(-300, 300)).tolist()) for i, v in enumerate(r.standard_normal((60, 6)))]
    good += [(2000, [1.7e308, -1.7e308, 0.0, 0.0, 0.0, 0.0]), (2100, [-1e-320, 0.0, 0.0, 0.0, 0.0, 5e-324])]
    table = spark.createDataFrame(good, "vec_id long, embedding array<double>")
    found = neighbours.neighbours(table, F.col("vec_id") % 100 == 0, shard_rows=150).collect()
    want = nearest(good, {i for i, _ in good if i % 100 == 0 and i < 1000})
    got = sorted(tuple(r) for r in found if r.query_id < 1000)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.95 * len(want)
    assert {q: sum(r.query_id == q for r in found) for q, _ in good if q % 100 == 0} == dict.fromkeys([*range(0, 400, 100), 1000, 2000, 2100], 10)
    with pytest.raises(ValueError, match="integer"):
        neighbours.neighbours(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))


def test_distances_in_any_range():
    v = np.array([3.0, 4.0])
    for power in (-1060, -900, 0, 500, 1000):
        got = neighbours.distances(np.ldexp(v[None], power), np.zeros(2))
        assert got[0] == pytest.approx(np.ldexp(5.0, power), rel=1e-3 if power < -1000 else 1e-12)
    assert neighbours.distances(np.array([[1.7e308, 0.0]]), np.array([-1.7e308, 0.0]))[0] == np.inf
    assert neighbours.distances(np.zeros((1, 2)), np.zeros(2))[0] == 0


def test_recall_over_a_large_shard(spark):
    r = np.random.default_rng(3)
    points = r.standard_normal((3000, 32)).astype(np.float32)
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    found = neighbours.neighbours(table, F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 3000, 100):
        d = ((points.astype(float) - points[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & {r.vec_id for r in found if r.query_id == q})
    assert hits >= 0.9 * 300


def test_robust_pruning_keeps_diverse_edges():
    # Two points in one direction: the farther one is hidden by the nearer.
    points = np.array([[0, 0], [1, 0], [2, 0], [0, 3]], np.float32)
    graph = neighbours.Graph(points, np.full((4, neighbours.DEGREE), -1, np.int32), 0)
    kept = graph.pruned(np.array([0]), np.array([[1, 2, 3, 0, -1, 1]]))
    assert [i for i in kept[0] if i >= 0] == [1, 3]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.neighbours(empty, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert neighbours.neighbours(one, F.col("vec_id") % 100 == 0).count() == 0


FILES = [
    (1, "p/LICENSE", "Released under the MIT License.", True),
    (2, "p/src/a.c", "int main() {}", False),
    (3, "p/src/gpl/COPYING", "intro\nThis work is licensed under the GNU General Public License, version 3.", True),
    (4, "p/src/gpl/deep/er/b.c", "no notice", False),
    (5, "p/src/c.c", "// Licensed under the Apache License, Version 2.0.\ncode", False),
    (6, "q/d.c", "", False),
    (7, "q/e.c", None, False),
    (8, None, "x", False),
    (9, None, "Licensed under CC BY-NC 4.0.", True),
    (10, "pp/x.c", "released late", False),
    (11, "p/src/gpl/LICENSE", "licensed under the apache license, version 2.0", None),
    (12, "r/LICENSE", "Licensed under the\nApache License,\nVersion 2.0.", True),
    (13, "r/x/y", "word " * 30_000, False),
    (2, "p/src/a.c", "int main() {}", False),
]


def test_licences_are_found_and_inherited(spark):
    files = spark.createDataFrame(FILES, "id int, path string, text string, speaks boolean")
    files = files.withColumn("licence", F.lit("kept")).withColumn("n", F.lit(1))
    found = licences.scan(files, "path", "text", "speaks")
    got = {r.row.id: (r.licence, r.inherited_from) for r in found.collect()}
    assert found.count() == len(FILES)
    assert {r.row.licence for r in found.collect()} == {"kept"}
    assert got == {
        1: ("MIT", None),
        2: ("MIT", "p"),
        3: ("GPL-3.0", None),
        4: ("GPL-3.0", "p/src/gpl"),
        5: ("Apache-2.0", None),
        6: (None, None),
        7: (None, None),
        8: (None, None),
        9: ("CC-BY-NC-4.0", None),
        10: (None, None),
        11: ("Apache-2.0", None),
        12: ("Apache-2.0", None),
        13: ("Apache-2.0", "r"),
    }
    place = {r.row.id: r.place for r in found.collect()}
    assert place[3] == 6 and place[5] == 0


def plain_best(texts, templates, least=0.8):
    """(licence, cosine, first line) of every text, by the cosines of all of its runs of lines."""
    def found(line):
        return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line))

    df = Counter(w for t in texts for w in set(found(t or "")))

    def vector(words):
        return {w: n * (1 + math.log((1 + len(texts)) / (1 + df[w]))) for w, n in Counter(words).items()}

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return round(sum(x * b.get(w, 0) for w, x in a.items()) / norm, 9)

    known, out = [(name, vector(found(t))) for name, t in templates], []
    for text in texts:
        lines = [own for own in map(found, (text or "").split("\n")) if own]
        runs = {(i, k) for k in licences.RUNS for i in range(len(lines) - k + 1)} | ({(0, len(lines))} if lines else set())
        best = min(
            ((-cosine(vector([w for own in lines[i : i + k] for w in own]), v), i, k, name) for i, k in runs for name, v in known),
            default=(0, 0, 0, None),
        )
        out.append((best[3], -best[0], best[1]) if -best[0] >= least else (None, None, None))
    return out


def test_cosines_equal_those_of_all_runs(spark):
    r = random.Random(4)
    some = [("A", "alpha beta gamma licence"), ("B", "beta gamma\ndelta licence words"), ("C", "one two three four five six seven eight")]
    words = "alpha beta gamma delta licence words one two three four five six seven eight noise more less".split()
    texts = [
        "\n".join(" ".join(r.choice(words) for _ in range(r.randrange(0, 6))) for _ in range(r.randrange(1, 30)))
        for _ in range(60)
    ]
    texts += [t for _, t in some] + [None, "", "\n\n", "Alpha, BETA: gamma-licence", "alpha beta gamma licence"]
    files = spark.createDataFrame([(i, f"p/{i}", t, False) for i, t in enumerate(texts)], "id int, path string, text string, speaks boolean")
    found = licences.scan(files, "path", "text", "speaks", keep=("id",), templates=some).collect()
    want = plain_best(texts, some)
    assert sum(w[0] is not None for w in want) > 10
    assert {r.row.id: (r.licence, r.cosine) for r in found} == {i: (w[0], w[1] and pytest.approx(w[1])) for i, w in enumerate(want)}
    for row in found:
        if row.place is not None:
            assert sum(bool(licences.words(x)) for x in texts[row.row.id][: row.place].split("\n")) == want[row.row.id][2]


def test_pieces_of_a_long_text(monkeypatch):
    templates = [("A", "alpha beta gamma licence")]
    table = licences.Templates(templates, 10, {b"alpha": 2, b"filler": 9})
    lines = [[b"filler"]] * 50 + [[b"alpha", b"beta"], [b"gamma", b"licence"]] + [[b"filler"]] * 61
    whole = table.candidates(lines, 0.8)
    for piece in (1, 7, 51):
        monkeypatch.setattr(licences, "PIECE", piece)
        assert sorted(table.candidates(lines, 0.8)) == sorted(whole)
    assert (50, 2) in whole


@pytest.mark.parametrize("others", [5, 3000])
def test_real_notices_are_recognised(spark, others):
    """Texts and headers of all licences, wrapped anew and among other lines, in small and large tables."""
    rows, want = [], {}

    def add(name, text, path, speaks=False):
        want[len(rows)] = name
        rows.append((len(rows), path, text, speaks))

    for name, texts in TEXTS.items():
        for k, text in enumerate(texts):
            wrapped = textwrap.fill(" ".join(text.split()), 64)
            add(name, f"Copyright (c) 2021 Jane Doe\n\n{wrapped}\n", f"full/{name}/{k}/LICENSE", True)
            body = "\n".join(f" * {line}" for line in text.split("\n"))
            add(name, f"/*\n{body}\n */\n#include <stdio.h>\nint main(void) {{ return 0; }}\n", f"src/{name}{k}.c")
        add(name, "int x;\n", f"full/{name}/0/deep/er/x.c")
        for k, spoken in enumerate(NAMES[name]):
            add(name, f"# Tool\nSome words about it.\nThis project is released under the {spoken}.\nMore words.\n", f"doc/{name}{k}.md")
            add(name, f"# Licensed under the {spoken}\nimport os\n", f"py/{name}{k}.py")
    for k in range(others):
        add(None, brute.prose(k, 40, 3000).replace(" w1", " the is of this project\n and to software w1"), f"other/{k}.txt")
    files = spark.createDataFrame(rows, "id int, path string, text string, speaks boolean")
    got = {r.row.id: r.licence for r in licences.scan(files, "path", "text", "speaks", keep=("id",)).collect()}
    wrong = {rows[i][1]: (got[i], name) for i, name in want.items() if got[i] != name}
    assert not wrong


def test_directories_of_a_path(spark):
    paths = spark.createDataFrame([("a/b/c",), ("c",), ("/a/",), ("",)], "p string")
    got = [r.d for r in paths.select(licences.directories(F.col("p")).alias("d")).collect()]
    assert got == [["a/b", "a", ""], [""], ["/a", "", ""], [""]]


def test_no_files(spark):
    files = spark.createDataFrame([], "id int, path string, text string, speaks boolean")
    assert licences.scan(files, "path", "text", "speaks").count() == 0
