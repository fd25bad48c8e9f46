"""The queries from another folder, with workers that can't import the package; the entry without a library."""
import os
import subprocess
import sys

ROOT = os.path.abspath(os.path.join(os.path.dirname(__file__), "..", ".."))

ELSEWHERE = """
import importlib, os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.range(4).rdd.map(lambda x: x).count()  # workers start before the package is known
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
assert spark.sparkContext.parallelize([1], 1).map(lambda _: importlib.util.find_spec("panelwright") is None).first()
known = entry.queries()
for name in {names!r}:
    print(name, known[name](spark, "/root/testdata/sf0.001").count())
"""

NAMES = ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op9_", "op11_", "op12_", "op13_"]


def run(code, **more):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | more
    return subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=900)


def test_workers_need_not_import_the_package():
    from panelwright.llm import queries

    names = [n for n in queries.QUERIES if n.startswith(tuple(NAMES))] + ["pipeline"]
    done = run(ELSEWHERE.format(root=ROOT, names=names))
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.splitlines()) >= len(names)


def test_the_entry_without_a_library():
    code = f"import sys; sys.modules['xxhash'] = None; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    done = run(code)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) > 200
