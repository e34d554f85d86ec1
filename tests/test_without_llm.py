import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "passagemill", tmp_path / "passagemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); assert 'seg_chunks' in q and set(o) <= set(q); assert not any(k.startswith('op') or k == 'pipeline' for k in q)"
    code += """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("seg_chunks", "generate_questions"):
    assert q[name](spark, "/root/testdata/sf0.001").count() > 0
"""
    ran = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr


def test_nothing_else_imports_them():
    for path in (ROOT / "passagemill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
