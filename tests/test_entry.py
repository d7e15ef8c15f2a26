"""The entry point with and without the part for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.parquet"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and not any(x.startswith('op') for x in q), q"
    for gone in ([], ["corpus_pipeline.py"]):
        for name in gone:
            (copy / name).unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
