"""Executors without a copy of the repository."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
#: Runs in a folder of its own; only the driver is told where the package is, after its workers' environment was fixed.
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
def importable(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"found": [importlib.util.find_spec("gable") is not None]})
before = spark.range(1).mapInArrow(importable, "found boolean").first()[0]
sys.path.insert(0, sys.argv[1])
from gable.llm import queries
assert not before and not spark.range(1).mapInArrow(importable, "found boolean").first()[0]
for name in sys.argv[3:]:
    print(name, queries.REGISTERED[name](spark, sys.argv[2]).count(), flush=True)
"""


def test_queries_run_where_workers_lack_the_package(tmp_path, docs_of, spark, table_dir):
    texts = [(i, f"the quick brown fox number {i % 7} jumps over a lazy dog {'again ' * (i % 5)}", "en") for i in range(30)]
    item = spark.createDataFrame([("a", "the quick brown fox number 3 jumps over a lazy dog again")], "item_id string, text string")
    vectors = spark.range(20).selectExpr("id AS vec_id", "array_repeat(cast(id AS float), 16) AS embedding", "1 AS label")
    labels = spark.range(30).selectExpr("id AS doc_id", "1 AS quality", "cast(id % 2 AS int) AS toxic")
    folder = table_dir(documents=docs_of(texts), benchmark=item, embeddings=vectors, labels=labels)
    from gable.llm import queries

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), folder, *queries.REGISTERED], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stdout + run.stderr[-3000:]
    wanted = {name: 1 if "search" in name else 20 if "vector" in name else 30 for name in queries.REGISTERED}
    found = dict(line.split() for line in run.stdout.splitlines() if line.startswith("op"))
    assert set(found) == set(wanted)
    assert all(int(found[n]) == wanted[n] for n in wanted if "search" not in n)
