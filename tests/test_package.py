"""The package as a user meets it: started elsewhere, without a path to it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", "{ROOT}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("trend_forecast", "scan_text_files", "isolation_scores", "generate_briefs"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_python_steps_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_folders_are_released(tmp_path):
    """In a process of its own: what a session has written goes when its results are no longer needed."""
    script = f"""
import sys; sys.path.insert(0, "{ROOT}")
from spendtide import session
spark = session.build_session("t", "local[1]", spark__ui__enabled="false", spark__checkpoint__dir="{tmp_path}/shared")
df = session.staged(spark.range(5))
assert df.count() == 5 and session.release(spark) == 1 and session.release(spark) == 0
import os
print("left", [p for p in os.listdir("{tmp_path}/shared") if p.startswith("stage")])
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "left []" in done.stdout, done.stderr[-3000:]
