"""Every query of this subpackage runs where executors have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "2g").config("spark.checkpoint.dir", f"file://{sys.argv[3]}/shared").getOrCreate()
)
from pyspark.sql import functions as F
def seen(_):
    import importlib.util
    yield importlib.util.find_spec("tidemark") is None
assert all(spark.sparkContext.parallelize(range(4), 4).mapPartitions(seen).collect())
import __spark_entry__ as entry
for name, query in entry.queries().items():
    if name == "pipeline" or name.startswith("op") and name[2].isdigit():
        assert query(spark, sys.argv[2]).toArrow().num_rows > 0, name
print("all ran")
"""


def test_executors_need_no_copy(small, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), small, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "all ran" in run.stdout, run.stderr[-3000:]
