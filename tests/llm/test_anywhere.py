"""Tasks import the package wherever the job is started."""

import os
import subprocess
import sys
import tempfile

from tests.conftest import SMOKE


def test_queries_run_from_another_folder():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in ("op1_html_extraction", "op3_suffix_dedup", "op5_benchmark_decontamination", "op8_embedding_near_dedup"):
    assert e.queries()[name](s, {SMOKE!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tempfile.mkdtemp(), env=env, timeout=300)
