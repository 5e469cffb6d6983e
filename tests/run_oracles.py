"""Run registered queries against DuckDB: ``python tests/run_oracles.py [sf] [name …]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from compare import connect, difference

sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
names = sys.argv[2:] or list(entry.queries())
spark = (
    SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
oracles = entry.oracle_sql()
failed = 0
for name in names:
    started = time.time()
    try:
        problem = difference(entry.queries()[name](spark, sf_dir), con, oracles[name]) if name in oracles else "no oracle"
    except Exception as error:
        problem = f"{type(error).__name__}: {str(error)[:600]}"
    failed += problem is not None
    print(f"{'ok  ' if problem is None else 'FAIL'} {name:32s} {time.time() - started:6.2f}s {problem or ''}", flush=True)
print("failed:", failed)
