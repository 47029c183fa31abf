"""The entry file works from any folder, and workers need no copy of the package."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ENTRY = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry_file", {str(ENTRY)!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
spark = (
    SparkSession.builder.master("local[2]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2")
    .getOrCreate()
)
for name in ("top_k", "embed_text", "top_k_join_in_blocks"):
    print(name, module.queries()[name](spark, module.SMALL).count())
"""


def test_queries_run_from_another_folder(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "top_k 5" in done.stdout
    assert "embed_text 200" in done.stdout
