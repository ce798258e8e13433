"""The registered queries without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PRINT_NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(folder):
    out = subprocess.run([sys.executable, "-c", PRINT_NAMES], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    return [line.split() for line in out.stdout.splitlines()[-2:]]


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_queries_without_the_optional_parts(tmp_path, also):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "tests", *also)
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    queries, sql = names(tmp_path / "copy")
    assert "batch_markers" in queries and set(sql) <= set(queries)
    assert "pipeline" not in queries and not [q for q in queries if q.startswith("op") and "_" in q and q[2].isdigit()]
