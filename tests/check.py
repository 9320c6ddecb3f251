"""Run registered queries against their SQL: check.py SF [NAME ...]"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from compare import connect, mismatch  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

sf_dir = f"/root/testdata/sf{sys.argv[1]}"
spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.session.timeZone", "UTC")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
names = sys.argv[2:] or list(entry.queries())
bad = 0
for name in names:
    start = time.time()
    try:
        df = entry.queries()[name](spark, sf_dir)
        sql = entry.oracle_sql().get(name)
        problem = f"no sql, {df.count()} rows" if sql is None else mismatch(df, con, sql)
    except Exception as e:  # report and go on
        problem = f"{type(e).__name__}: {str(e)[:1500]}"
    bad += bool(problem)
    print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
print("not equal:", bad)
