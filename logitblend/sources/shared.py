"""Where a job may keep tables that all executors must see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The folder of a local session that names none.
_own: dict[str, str] = {}


def _application_folder(spark: SparkSession) -> str:
    """The application's own folder below the one the cluster names in
    ``spark.checkpoint.dir``.  Only local mode may fall back to a temporary folder of
    the machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _own.get(context.applicationId)
        if root is None:
            root = _own[context.applicationId] = tempfile.mkdtemp(prefix="logitblend-")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, purpose: str, key: str | None = None) -> str:
    """A new folder name in the application's shared folder; with a ``key``, the same
    name for it all through the application, to be written over."""
    digest = uuid.uuid4() if key is None else uuid.uuid5(uuid.NAMESPACE_URL, key)
    return f"{_application_folder(spark)}/{purpose}-{digest.hex}"


def clear(spark: SparkSession) -> None:
    """Delete what the application has kept in the shared folder.  For the end of a job:
    tables that are still to be read depend on it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(path, True)


def written(table: DataFrame, purpose: str) -> DataFrame:
    """The table written once below the shared folder and read back, so that
    what uses it twice does not compute it twice."""
    spark = table.sparkSession
    folder = shared_folder(spark, purpose)
    table.write.parquet(folder)
    return spark.read.schema(table.schema).parquet(folder)
