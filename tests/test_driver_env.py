"""Queries whose Python runs inside workers must work when the executors
cannot import this package (the driver adds the repo to its own path only).
The pytest process runs from the repo folder, which would hide such a bug,
so the check runs in a fresh process started elsewhere."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false") \\
    .config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as E
for n in ["t6_decode_log", "x2_stream_sessions", "x6_stream_transcripts"]:
    print(n, E.queries()[n](spark, "/root/testdata/sf0.001").count())
"""


def test_worker_side_python_without_package_on_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    counts = dict(line.split() for line in out.stdout.strip().splitlines())
    assert set(counts) == {"t6_decode_log", "x2_stream_sessions", "x6_stream_transcripts"}
    assert all(int(v) > 0 for v in counts.values())
