"""The library without its corpus subpackage: the entry still imports and lists the other queries."""

from __future__ import annotations

import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_corpus_operators():
    copy = Path(tempfile.mkdtemp(prefix="spark-")) / "repo"
    shutil.copytree(ROOT / "tallyworks", copy / "tallyworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'u10_session_cost' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "tallyworks").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
