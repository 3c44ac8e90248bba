"""The registered queries, and that the library stands without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_points

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_imports_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "vulnlake", tmp_path / "vulnlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'merge_sources' in q and 'pipeline' not in q; assert not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
