"""Folders to which calls append, each of them wholly or not at all.

A call writes its files to a hidden folder, moves them to their places, and at last
leaves a record that names them, below ``_calls``.  Readers take the files that
records name.  A call that dies before its record has added nothing, and one that is
repeated under the same name, after it had succeeded, adds nothing again."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

#: Folder of the records; readers that don't know of it pass over it.
RECORDS = "_calls"
STAGING = "_staging"


@dataclass(frozen=True)
class Call:
    """A call that has succeeded: its name, its number (nanoseconds, later ones larger), whether it
    replaced what was there, its files, relative to the folder, and numbers that the caller noted."""

    name: str
    number: int
    replaces: bool
    files: tuple[str, ...]
    note: tuple[int, ...] = ()


class Folder:
    """A folder as the cluster's file system sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = self._class(self.path)
        self.store = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        found = self.root
        for part in parts:
            found = self._class(found, self._class(None, None, part))
        return found

    def files(self, *parts: str) -> list[str]:
        """All files below, relative to this folder, in order of name.  Hidden ones below are left out."""
        top = self.at(*parts)
        if not self.store.exists(top):
            return []
        base = self.store.makeQualified(self.root).toUri().getPath().rstrip("/") + "/"
        walk, found = self.store.listFiles(top, True), []
        here = self.store.makeQualified(top).toUri().getPath().rstrip("/") + "/"
        while walk.hasNext():
            name = walk.next().getPath().toUri().getPath()
            if not any(p.startswith(("_", ".")) for p in name.removeprefix(here).split("/")):
                found.append(name.removeprefix(base))
        return sorted(found)

    def move(self, source, target) -> None:
        """A move that fails where the file system only says no, or the name is taken."""
        if self.store.exists(target):
            raise FileExistsError(str(target))
        self.store.mkdirs(target.getParent())
        if not self.store.rename(source, target):
            raise OSError(f"{source} could not be moved to {target}")

    def write(self, text: str, *parts: str) -> None:
        """A small file, which is there wholly or not at all."""
        spare = self.at(*parts[:-1], f".{uuid.uuid4().hex}")
        out = self.store.create(spare, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.move(spare, self.at(*parts))

    def delete(self, *parts: str) -> None:
        self.store.delete(self.at(*parts), True)


def recorded(spark: SparkSession, path: str) -> list[Call] | None:
    """The calls that make up a folder, first to last, or None if it has no records: then it
    was written elsewhere, and all of its files count."""
    folder = Folder(spark, path)
    if not folder.store.exists(folder.at(RECORDS)):
        return None
    names = [str(folder.at(f)) for f in folder.files(RECORDS)]
    rows = spark.read.text(names, wholetext=True).collect() if names else []
    read = [json.loads(r["value"]) for r in rows]
    calls = sorted((Call(**r | {"files": tuple(r["files"]), "note": tuple(r["note"])}) for r in read), key=lambda c: c.number)
    last = max((i for i, c in enumerate(calls) if c.replaces), default=0)
    return calls[last:]


def _record(folder: Folder, call: Call) -> None:
    """The last step of a call, which makes it count."""
    folder.write(json.dumps(call.__dict__), RECORDS, f"{uuid.uuid5(uuid.NAMESPACE_URL, call.name).hex}.json")


def add(
    rows: DataFrame,
    path: str,
    form: str,
    call: str | None = None,
    replace: bool = False,
    partition_by: tuple[str, ...] = (),
    number: int | None = None,
    note: Sequence[int] = (),
) -> bool:
    """Write ``rows`` to the folder as one call.  False if a call of that name has been
    recorded before; then nothing is written, unless it is to replace what is there.

    Files that were in the folder before its first record count as its first call."""
    spark = rows.sparkSession
    folder, number = Folder(spark, path), number or time.time_ns()
    known = recorded(spark, path)
    name = call or uuid.uuid4().hex
    if known is None and not replace:
        there = folder.files()
        if there:
            _record(folder, Call(f"before {name}", 0, False, tuple(there)))
    if not replace and any(c.name == name for c in known or ()):
        return False
    own = uuid.uuid4().hex
    try:
        rows.write.partitionBy(*partition_by).format(form).save(str(folder.at(STAGING, own)))
        files = []
        for file in folder.files(STAGING, own):
            parts = file.removeprefix(f"{STAGING}/{own}/").split("/")
            parts[-1] = f"{own}-{parts[-1]}"
            folder.move(folder.at(file), folder.at(*parts))
            files.append("/".join(parts))
        if replace:
            # The name may have been recorded by a call that this one takes the place of.
            folder.delete(RECORDS, f"{uuid.uuid5(uuid.NAMESPACE_URL, name).hex}.json")
        _record(folder, Call(name, number, replace, tuple(files), tuple(note)))
    finally:
        folder.delete(STAGING, own)
    if replace:
        for file in set(folder.files()) - set(files):
            folder.delete(file)
        for record in folder.files(RECORDS):
            if uuid.uuid5(uuid.NAMESPACE_URL, name).hex not in record:
                folder.delete(record)
    return True


def open_files(
    spark: SparkSession, path: str, reader: DataFrameReader, only: list[Call] | None = None
) -> tuple[DataFrameReader, list[str] | str]:
    """A reader, and what to read with it: the files of the recorded calls, or of ``only``
    some of them, or the folder itself if it has no records."""
    calls = recorded(spark, path) if only is None else only
    if calls is None:
        return reader, path
    folder = Folder(spark, path)
    names = [str(folder.at(f)) for c in calls for f in c.files]
    return reader.option("basePath", folder.path), names
