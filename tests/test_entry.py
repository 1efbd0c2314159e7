"""The entry points work from any folder, on a session made elsewhere."""

import os
import subprocess
import sys

ENTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                     "__spark_entry__.py")

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_module", {ENTRY!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.driver.bindAddress", "127.0.0.1")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
assert entry.entry(spark).count() == 5
# A query whose UDF needs the package on the executors.
assert entry.queries()["book_similarity"](spark, "/root/testdata/sf0.001").count() == 50
assert entry.queries()["impute_knn"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_other_folder_and_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
