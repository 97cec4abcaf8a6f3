import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, "/root/repo" if len(sys.argv) < 2 else sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.queries()["retrieval_topk"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    """A driver that only put the repository on its own path can run queries with Python workers."""
    from pathlib import Path

    repo = str(Path(__file__).resolve().parent.parent)
    (tmp_path / "run.py").write_text(CODE)
    got = subprocess.run([sys.executable, "run.py", repo], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "ROWS 110" in got.stdout, got.stderr[-2000:]
