"""Licence scans: TF-IDF cosine of headers and licence files to templates, inherited down directories.

1. The lines of a file that have words are numbered.  What is compared is every run of 1 to 24 lines, of the lengths in
   ``RUNS``, and the whole file: a notice may be one line or ten, and fill a file or stand above its code.
2. Words weigh their inverse document frequency over all files, which is counted in Spark for every word, not those of
   templates alone.  A run's and a template's sparse weight vectors are compared by cosine; the templates
   (``licence_texts``) are notices, whole texts and the beginnings of long ones.
3. Tasks hold the weights of the templates' words only.  Every other word weighs at least 1, which bounds a run's cosine from above;
   inner products and bounds of all runs come from sums over lines.  Only runs whose bound reaches ``THRESHOLD`` go on, with their
   other words, to be joined with the words' frequencies: their cosines are exact.
4. A file's own licence is that of its best run at ``THRESHOLD`` or more.  A licence file also speaks for its directory.  A
   file without a licence inherits that of the nearest ancestor directory for which one speaks: directories, each once, are joined with
   those above them (at depths where one speaks), and files with their directory.

Cosines are rounded to 9 digits before they are compared, so ties don't depend on the order of sums: they go to the run that starts
first, then to the shorter one, then to the smaller licence name.

Edge cases: a missing text has no lines; a missing path has no directory, so its file
inherits nothing; of two licence files in one directory the better match speaks, then the
smaller licence name; a very long text is compared in pieces of ``PIECE`` lines, which overlap, and its whole as others; repeated
files are repeated in the result; no files give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logitblend.llm.common import fresh, integer, over_texts, written
from logitblend.llm.licence_texts import templates as known_templates

THRESHOLD = 0.8
RUNS = (1, 2, 3, 4, 6, 8, 12, 16, 24)
PIECE = 4096
WHOLE = 0  # stands for the length of the whole file
DIGITS = 9
FILES = 256

_WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words(line: str) -> list[bytes]:
    return _WORD.findall(line.encode("utf-8", "replace").lower())


def frequencies(files: DataFrame, text: str) -> DataFrame:
    """``word, df``: the number of files with each word, and with the empty word the number of files."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(0):
                seen.update({b"", *words(value.as_py() or "")})
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                names=["word", "df"],
            )

    counted = files.select(F.col(text).cast("string")).mapInArrow(count, "word binary, df long")
    return written(counted.groupBy("word").agg(F.sum("df").alias("df")), "frequencies")


def weight(files: int, df: int) -> float:
    return 1.0 + math.log((1 + files) / (1 + df))


class Templates:
    """Weights of the templates' words, and unit vectors of the templates over them."""

    def __init__(self, templates: list[tuple[str, str]], files: int, frequency: dict[bytes, int]):
        counts = [Counter(words(text)) for _, text in templates]
        self.names = [name for name, _ in templates]
        self.vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
        self.weights = np.array([weight(files, frequency.get(w, 0)) for w in self.vocabulary])
        self.vectors = np.zeros((len(self.vocabulary), len(templates)))
        for t, own in enumerate(counts):
            for w, n in own.items():
                self.vectors[self.vocabulary[w], t] = n * self.weights[self.vocabulary[w]]
        norms = np.sqrt((self.vectors**2).sum(axis=0))
        self.vectors /= np.where(norms > 0, norms, 1.0)

    def candidates(self, lines: list[list[bytes]], threshold: float) -> list[tuple[int, int]]:
        """(first line, length) of the runs whose cosine may reach the threshold; the whole file has ``WHOLE``
        for its length."""
        found = []
        total, least, most = np.zeros(len(self.names)), 0.0, max(RUNS)
        for at in range(0, len(lines), PIECE):
            dots, squares = self._sums(lines[at : at + PIECE + most - 1])
            total += dots[: min(PIECE, len(lines) - at)].sum(axis=0)
            least += squares[:PIECE].sum()
            dots = np.concatenate([np.zeros((1, dots.shape[1])), np.cumsum(dots, axis=0)])
            squares = np.r_[0.0, np.cumsum(squares)]
            for k in RUNS:
                n = min(PIECE, len(squares) - k)
                if n <= 0:
                    break
                top = (dots[k : k + n] - dots[:n]).max(axis=1)
                near = top >= (threshold - 1e-6) * np.sqrt(np.maximum(squares[k : k + n] - squares[:n], 1e-12))
                found += [(at + int(i), k) for i in np.flatnonzero(near)]
        if total.max(initial=0.0) >= (threshold - 1e-6) * math.sqrt(least) and least:
            found.append((0, WHOLE))
        return found

    def _sums(self, lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """For each line its inner products with all templates, and a lower bound for its squared length; both of a
        run are at least the sums over its lines."""
        lengths = np.array([len(line) for line in lines])
        line = np.repeat(np.arange(len(lines)), lengths)
        number = np.fromiter(
            (self.vocabulary.get(w, -1) for own in lines for w in own), np.int64, int(lengths.sum())
        )
        inside = number >= 0
        # A word that no template has weighs 1 at least, and n of them n at least.
        squares = np.bincount(line[~inside], minlength=len(lines)).astype(np.float64)
        key, n = np.unique(line[inside] * len(self.weights) + number[inside], return_counts=True)
        own_line, own_word = np.divmod(key, len(self.weights))
        x = n * self.weights[own_word]
        squares += np.bincount(own_line, x * x, minlength=len(lines))
        dots = np.zeros((len(lines), len(self.names)))
        # A line's vector is no nearer to a template than it is to the template's words: others are passed over.
        for at in range(0, len(key), 1 << 13):
            part = slice(at, at + (1 << 13))
            rows, first = np.unique(own_line[part], return_index=True)
            dots[rows] += np.add.reduceat(x[part, None] * self.vectors[own_word[part]], first, axis=0)
        return dots, squares

    def run(self, own: Counter, threshold: float) -> tuple[float, list[tuple[int, float]], list[tuple[bytes, int]]]:
        """Of a run's words: the squared length of those that templates have, the templates that may still be near, with
        inner products, and the other words with their counts."""
        inside = [(self.vocabulary[w], n) for w, n in sorted(own.items()) if w in self.vocabulary]
        others = [(w, n) for w, n in sorted(own.items()) if w not in self.vocabulary]
        number = np.array([i for i, _ in inside], np.int64)
        x = np.array([n for _, n in inside]) * self.weights[number]
        square = float((x * x).sum())
        dots = x @ self.vectors[number]
        least = math.sqrt(square + sum(n * n for _, n in others))
        near = np.flatnonzero(dots >= (threshold - 1e-6) * least)
        return square, [(int(t), float(dots[t])) for t in near], others


_RUN = (
    "struct<line: int, length: int, place: long, square: double, "
    "near: array<struct<template: int, dot: double>>, others: array<struct<word: binary, n: int>>>"
)
_RUN_TYPE = pa.struct(
    [
        ("line", pa.int32()), ("length", pa.int32()), ("place", pa.int64()), ("square", pa.float64()),
        ("near", pa.list_(pa.struct([("template", pa.int32()), ("dot", pa.float64())]))),
        ("others", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))),
    ]
)


def _runs_of(table: Templates, text: str | None, threshold: float) -> list[dict]:
    """The runs of a text that may be near a template."""
    lines, places, at = [], [], 0
    for line in (text or "").split("\n"):
        own = words(line)
        if own:
            lines.append(own)
            places.append(at)
        at += len(line) + 1
    out = []
    for first, length in table.candidates(lines, threshold):
        if length == WHOLE and len(lines) in RUNS:
            continue  # a run like others
        part = lines[first : first + length] if length else lines
        square, near, others = table.run(Counter(w for own in part for w in own), threshold)
        if near:
            out.append(
                {
                    "line": first,
                    "length": length or len(lines),
                    "place": places[first],
                    "square": square,
                    "near": [{"template": t, "dot": d} for t, d in near],
                    "others": [{"word": w, "n": n} for w, n in others],
                }
            )
    return out


def _best_runs(found: DataFrame, frequency: DataFrame, files: int, names: list[str], threshold: float) -> DataFrame:
    """``n, licence, cosine, place`` of the best run of each file that has one."""
    runs = found.select("n", F.explode("runs").alias("run")).withColumn("id", F.struct("n", "run.line", "run.length"))
    others = runs.select("id", F.explode("run.others").alias("other")).select(
        "id", "other.n", F.col("other.word").alias("word")
    )
    x = F.col("n") * (1 + F.log((1 + F.lit(files)) / (1 + F.col("df"))))
    rest = others.join(frequency, "word").groupBy("id").agg(F.sum(x * x).alias("rest"))
    named = F.element_at(F.lit(names), F.col("near.template") + 1)
    return (
        runs.join(rest, "id", "left")
        .withColumn("norm", F.sqrt(F.col("run.square") + F.coalesce("rest", F.lit(0.0))))
        .select("n", "run.line", "run.length", "run.place", "norm", F.explode("run.near").alias("near"))
        .withColumn("cosine", F.round(F.col("near.dot") / F.col("norm"), DIGITS))
        .filter(F.col("cosine") >= threshold)
        .groupBy("n")
        .agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "line", "length", named.alias("licence"), "place")).alias("best"))
        .select("n", "best.licence", (-F.col("best.minus")).alias("cosine"), "best.place")
    )


def directories(path: Column) -> Column:
    """Every directory above a path like ``a/b/c``, the deepest first: a/b, a, and the
    root, an empty one."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)),
        lambda k: F.array_join(F.slice(parts, 1, k), "/"),
    )


def _inherited(found: DataFrame, path: Column, speaks: Column) -> DataFrame:
    """``home, theirs, directory``: for directories of files without a licence, the licence of the nearest directory, the
    same or one above, for which a file speaks."""
    # One licence for each directory: better matches first, then by name.
    order = F.struct((-F.col("cosine")).alias("c"), F.col("licence"))
    spoken = written(
        found.filter(speaks & F.col("licence").isNotNull() & path.isNotNull())
        .groupBy(F.element_at(directories(path), 1).alias("directory"))
        .agg(F.min(order).alias("o"))
        .select("directory", F.col("o.licence").alias("theirs")),
        "spoken",
    )
    parts = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    depths = [r["depth"] for r in spoken.select(parts.alias("depth")).distinct().collect()]
    asking = found.filter(F.col("licence").isNull() & path.isNotNull())
    above = (
        asking.select(F.element_at(directories(path), 1).alias("home"), (F.size(F.split(path, "/")) - 1).alias("own"))
        .distinct()
        .select("home", "own", F.explode(F.lit(depths) if depths else F.array().cast("array<int>")).alias("depth"))
        .filter("depth <= own")
        .withColumn("directory", F.array_join(F.slice(F.split("home", "/"), F.lit(1), F.col("depth")), "/"))
    )
    return (
        above.join(spoken, "directory")
        .groupBy("home", "own")
        .agg(F.max(F.struct("depth", "directory", "theirs")).alias("nearest"))
        .select("home", "own", "nearest.theirs", "nearest.directory")
    )


def scan(
    files: DataFrame,
    path: str,
    text: str,
    speaks: str,
    keep: tuple[str, ...] | None = None,
    templates: list[tuple[str, str]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``row`` (the columns to keep, all if None), ``licence`` (None if none), ``cosine`` of
    its own best run (None if none reaches the threshold), ``place`` of that run in the text, and ``inherited_from``, the
    directory if the licence isn't the file's own.  ``speaks`` is a boolean column: licence files."""
    templates = known_templates() if templates is None else templates
    frequency = frequencies(files, text)
    vocabulary = {w for _, t in templates for w in words(t)}
    # As many rows as the templates have words.
    listed = files.sparkSession.createDataFrame([(bytearray(w),) for w in sorted(vocabulary | {b""})], "word binary")
    df = {bytes(r["word"]): r["df"] for r in frequency.join(F.broadcast(listed), "word").collect()}
    n_files = integer(df.pop(b"", 0))
    table = Templates(templates, n_files, df)

    def prepare():
        def find(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([_runs_of(table, t.as_py(), threshold) for t in texts], pa.list_(_RUN_TYPE))]

        return find

    own_path, own_speaks = fresh(files, "own_path", "own_speaks")
    columns = files.columns if keep is None else list(keep)
    packed = files.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("kept"),
        F.col(path).cast("string").alias(own_path),
        F.coalesce(F.col(speaks), F.lit(False)).alias(own_speaks),
        F.col(text).cast("string").alias("scanned"),
    )
    scanned = written(
        over_texts(packed, "scanned", ("kept", own_path, own_speaks), f"runs array<{_RUN}>", prepare, FILES).select(
            F.col("row.kept").alias("row"),
            F.col(f"row.{own_path}").alias("path"),
            F.col(f"row.{own_speaks}").alias("speaks"),
            "runs",
            F.monotonically_increasing_id().alias("n"),
        ),
        "scanned",
    )
    best = _best_runs(scanned.filter(F.size("runs") > 0), frequency, n_files, table.names, threshold)
    found = written(scanned.drop("runs").join(best, "n", "left"), "licences")
    theirs = _inherited(found, F.col("path"), F.col("speaks"))
    columns = ["row", "licence", "cosine", "place"]
    asking = F.col("licence").isNull() & F.col("path").isNotNull()
    home, own = F.element_at(directories(F.col("path")), 1), F.size(F.split("path", "/")) - 1
    # Only files that ask take part in the join: those without a key would all meet in one task.
    heirs = found.filter(asking).join(theirs, (home == theirs["home"]) & (own == theirs["own"]), "left")
    return (
        heirs.select("row", F.col("theirs").alias("licence"), "cosine", "place", F.col("directory").alias("inherited_from"))
        .unionAll(found.filter(~asking).select(*columns, F.lit(None).cast("string").alias("inherited_from")))
    )
