"""Jobs run where the executors have no copy of this package."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as e
assert e.entry(spark).count() > 0
queries = e.queries()
for name in {names!r}:
    assert queries[name](spark, "/root/testdata/sf0.001").count() >= 0, name
print("done")
"""


def test_functions_travel_by_value(tmp_path):
    names = ["semantic_topk", "search_ann", "lexical_bm25", "chunk_library", "embed_documents", "stream_index"]
    script = SCRIPT.format(root=str(Path(__file__).resolve().parents[1]), names=names)
    # Another working directory: workers would otherwise import the package from it.
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and "done" in run.stdout, run.stderr[-3000:]
