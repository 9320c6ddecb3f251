"""Question sets, prompts and result files as JSON Lines and text."""

from __future__ import annotations

import re
import time
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logitblend.schemas import RESULTS
from logitblend.sources import calls
from logitblend.sources.places import file_order, with_places

#: Field that tells appended result records apart.
BATCH = "batch"
_CORRUPT, _RECORD = "_corrupt_line", "_record"


# What file names can't hold, or hide by, and how it is written in them.
_ESCAPES = {"/": "%2F", ":": "%3A", "_": "%5F", ".": "%2E", "%": "%25"}


def subject_of_file() -> Column:
    """File name without folder and extension.  A plus is a plus, and a percent sign that escapes nothing
    stays; only what :func:`write_subjects` escapes is read back as what it was."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    # The path is a URI.
    subject = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    for plain, escaped in _ESCAPES.items():
        subject = F.replace(subject, F.lit(escaped), F.lit(plain))
    return subject


def _file_of_subject(subject: str) -> str:
    name = re.sub("%(?=2F|3A|5F|2E|25)", "%25", subject)
    name = name.replace("/", _ESCAPES["/"]).replace(":", _ESCAPES[":"])
    return (_ESCAPES[name[0]] + name[1:] if name[:1] in ("_", ".") else name) + ".jsonl"


def _scan(
    spark: SparkSession,
    path: str,
    schema: str,
    where: str | Column | None,
    bad: str,
    only: list[calls.Call] | None = None,
) -> DataFrame:
    """Rows of the lines that are records of the schema.  With ``bad="fail"`` a line that isn't one
    ends the query; with ``"quarantine"`` it is left out, for :func:`bad_lines` to show."""
    if bad not in ("fail", "quarantine"):
        raise ValueError(f"bad must be 'fail' or 'quarantine', not {bad!r}")
    if bad == "fail":
        reader, files = calls.open_files(
            spark, path, spark.read.schema(schema).option("mode", "FAILFAST"), only
        )
        rows = reader.json(files) if files else spark.createDataFrame([], schema)
    else:
        lines = _parsed_lines(spark, path, schema, only)
        if lines is None:
            rows = spark.createDataFrame([], schema)
        else:
            # A column that folders name stands for the field.
            fields = [f.name for f in T.StructType.fromDDL(schema).fields]
            folders = [c for c in lines.columns if c not in ("value", _RECORD)]
            rows = lines.filter(F.col(f"{_RECORD}.{_CORRUPT}").isNull() & ~F.expr(_BLANK)).select(
                *[F.col(c) if c in folders else F.col(f"{_RECORD}.{c}") for c in fields],
                *[c for c in folders if c not in fields],
            )
    return rows if where is None else rows.filter(where)


_BLANK = "trim(value) = ''"


def _parsed_lines(
    spark: SparkSession, path: str, schema: str, only: list[calls.Call] | None = None
) -> DataFrame | None:
    """Lines with their record, whose mark is set where they aren't one; None without files."""
    reader, files = calls.open_files(spark, path, spark.read, only)
    if not files:
        return None
    kind = T.StructType.fromDDL(f"{schema}, {_CORRUPT} string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return reader.text(files).withColumn(_RECORD, F.from_json("value", kind, options))


def bad_lines(
    spark: SparkSession, path: str, schema: str, where: str | Column | None = None
) -> DataFrame:
    """The lines that are no records of a schema: ``file``, ``line`` (from 1), ``text``, and ``fault``:
    ``json`` where the line isn't JSON, as when it was cut, or ``type`` where a field has another type.
    Empty lines are nobody's records, and no fault."""
    lines = _parsed_lines(spark, path, schema)
    if lines is None:
        return spark.createDataFrame([], "file string, line bigint, text string, fault string")
    if where is not None:
        lines = lines.filter(where)
    numbered = with_places(lines.select("value", _RECORD, file_order().alias("at")), "at", by_file=True)
    is_json = F.from_json("value", "variant", {"mode": "PERMISSIVE"}).isNotNull()
    return numbered.filter(F.col(f"{_RECORD}.{_CORRUPT}").isNotNull() & ~F.expr(_BLANK)).select(
        F.col("at.file").alias("file"),
        (F.col("place") + 1).alias("line"),
        F.col("value").alias("text"),
        F.when(is_json, "type").otherwise("json").alias("fault"),
    )


def read_items(
    spark: SparkSession, path: str, schema: str, where: str | Column | None = None, bad: str = "fail"
) -> DataFrame:
    """Rows of a question set with their file order in ``seq``."""
    rows = _scan(spark, path, schema, where, bad)
    return rows.select("*", file_order().alias("seq"))


def read_subjects(
    spark: SparkSession, folder: str, schema: str, where: str | Column | None = None, bad: str = "fail"
) -> DataFrame:
    """Rows of all files of a folder; the subject of a row is its file's name."""
    rows = _scan(spark, folder, schema, where, bad)
    return rows.select("*", subject_of_file().alias("subject"), file_order().alias("seq"))


def read_prompt(spark: SparkSession, path: str) -> str:
    """A prompt file as one string, which enters plans as a literal; an empty file is an empty
    one."""
    whole = spark.read.text(path, wholetext=True).first()
    return "" if whole is None else whole["value"]


def write_results(
    records: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: tuple[str, ...] = (),
    call: str | None = None,
) -> bool:
    """Result records as JSON Lines.  Tasks write their own rows; a large
    dataset becomes more files, not a longer task.

    A call's records count wholly or not at all, and once: a call that died may be made again, and a
    call whose name (``call``) has succeeded before adds nothing, and returns False.  Every record has the
    number of its call, the time in nanoseconds: what was appended later comes later, whatever
    its files are called."""
    number = time.time_ns()
    numbered = records.drop(BATCH).withColumn(BATCH, F.lit(number))
    return calls.add(numbered, path, "json", call, mode == "overwrite", partition_by, number)


def read_results(
    spark: SparkSession,
    path: str,
    task: str,
    where: str | Column | None = None,
    numbered: bool = True,
    bad: str = "fail",
    only: list[calls.Call] | None = None,
) -> DataFrame:
    """Result records of a task (math, choice or qa).  ``order``, never null, tells which
    comes first: by call of :func:`write_results`, then by ``seq``, then by place in the files.
    Files written elsewhere may lack numbers; they come first, in order of file name.  ``only`` some
    of the recorded calls may be read."""
    rows = _scan(spark, path, f"{RESULTS[task]}, {BATCH} bigint", where, bad, only)
    if not numbered:
        return rows.drop(BATCH)
    order = F.struct(
        F.coalesce(BATCH, F.lit(0)).alias("batch"), F.col("seq").alias("seq"), file_order().alias("at")
    )
    return rows.select("*", order.alias("order")).drop(BATCH)


def write_subjects(items: DataFrame, folder: str, order: str) -> None:
    """Items in one file per subject, ``<subject>.jsonl``, as :func:`read_subjects` wants
    them, in order of a column that isn't written.  Each subject is written by one task, a file being one piece,
    however long; then the files are renamed, which moves names only, and fails where a name
    is taken.  Characters that files can't hold, like a slash, are escaped (``%2F``) in the file's name."""
    sorted_items = items.repartition("subject").sortWithinPartitions("subject", order).drop(order)
    writer = sorted_items.write.mode("overwrite").option("maxRecordsPerFile", 0)
    writer.partitionBy("subject").json(folder)
    place = calls.Folder(items.sparkSession, folder)
    written = [f for f in place.files() if f.startswith("subject=")]
    # Spark has escapes of its own for names of folders.
    named = [(f, unquote(f.split("/")[0].removeprefix("subject="))) for f in written]
    twice = sorted({n for _, n in named if sum(n == other for _, other in named) > 1})
    if twice:
        raise OSError(f"more than one file for {twice}")
    for file, name in named:
        place.move(place.at(file), place.at(_file_of_subject(name)))
    for file, _ in named:
        place.delete(file.split("/")[0])
