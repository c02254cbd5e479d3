"""The entry module without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def test_entry_without_llm(tmp_path):
    for name in ("millrace", "tests"):
        shutil.copytree(HERE / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split() == ["18", "18"], said.stderr


def test_nothing_else_imports_llm():
    for f in (HERE / "millrace").rglob("*.py"):
        if "llm" not in f.relative_to(HERE).parts:
            assert "llm" not in f.read_text(), f
