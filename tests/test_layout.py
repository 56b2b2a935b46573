"""The repository without its training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_lives_without_the_training_data_folders(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for folder in ("lectern/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    for name in also:
        (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, check=False).returncode == 0
