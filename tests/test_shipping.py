"""Queries find the package from any working folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ENTRY = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", entry.queries()["extract_xml_changes"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_find_the_package(tmp_path):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(ENTRY)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.rpartition("ROWS")[2]) > 0


def test_lenient_json_survives(spark):
    from folioflow.operators.extraction import _reprint_json

    texts = ['{"a":1,"a":"\\ud800"}', '{"score":NaN,"file":"x"}', "{", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(_reprint_json("t").alias("t")).collect()
    assert [r.t for r in rows] == ['{"a": "\\ud800"}', '{"score": null, "file": "x"}', None, None]
