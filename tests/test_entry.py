import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

WITHOUT = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "tidemark.llm") or name.startswith("tidemark.llm."):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert len(e.queries()) > 40 and "pipeline" not in e.queries() and not any(q.startswith("op") and q[2].isdigit() for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_imports_without_the_training_data_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], check=True, cwd=ROOT)


def test_entry_query(spark, small):
    import __spark_entry__ as e

    assert e.queries()["video_metrics"](spark, small).count() > 0
