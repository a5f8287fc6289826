"""Queries of the exam core with all exams and permutations that they register, against their SQL."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ("exam_summary", "student_exam_totals", "granularity_summary", "mcnemar_all_pairs", "permutation_test_qwk")

RUN = """
import sys
sys.path[:0] = [{root!r}, {root!r} + "/tests"]
import duckdb
from pyspark.sql import SparkSession
from marksheet import fixtures
from marksheet.queries import ORACLES, QUERIES
from test_queries import SF, TABLES, plain

assert (fixtures.RUNS, fixtures.PERMUTATIONS) == (500, 10_000)
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
con = duckdb.connect()
for t in TABLES:
    con.sql(f"CREATE VIEW {{t}} AS SELECT * FROM '{{SF}}/{{t}}.parquet'")
for name in {names!r}:
    mine, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(theirs.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))
    assert sorted(mine.columns) == columns and rows(mine) == rows(theirs), name
print("all equal")
"""


def test_registered_sizes():
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, names=NAMES)], capture_output=True, text=True, cwd=ROOT, check=False)
    assert done.returncode == 0 and "all equal" in done.stdout, done.stderr[-2000:]
