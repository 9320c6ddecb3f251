import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture
def frame(spark):
    """Documents as a table with columns whose names operators use, too."""

    def make(rows, extra=True):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        if extra:
            for name in ("size", "row", "fp", "n", "number", "shard", "bucket", "component", "copies"):
                docs = docs.selectExpr("*", f"'kept' AS `{name}`")
        return docs.repartition(3)

    return make
