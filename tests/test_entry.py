"""The registry with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(' '.join(sorted(e.queries()))); print(' '.join(sorted(e.oracle_sql())))"


def asked(folder, *before):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=os.environ | {"PYTHONPATH": os.pathsep.join(map(str, (*before, folder, *filter(None, [os.environ.get("PYTHONPATH")]))))}, capture_output=True, text=True, check=True).stdout
    return [line.split() for line in out.splitlines()[-2:]]


def test_without_the_separable_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    names, sql = asked(copy)
    assert "connection_page" in names and set(sql) <= set(names)
    assert not [n for n in names if n.startswith("op") or n == "pipeline"]


def test_without_a_library_of_the_separable_part(tmp_path):
    """An engine without the other part's libraries still has all its own queries."""
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError(\"No module named 'xxhash'\", name='xxhash')")
    names, sql = asked(ROOT, tmp_path)
    assert "connection_page" in names and set(sql) <= set(names)
    assert not [n for n in names if n.startswith("op") or n == "pipeline"]


def test_as_it_is():
    names, sql = asked(ROOT)
    assert set(sql) <= set(names)


def test_nothing_else_imports_the_separable_part():
    for path in (ROOT / "heddle").rglob("*.py"):
        if "llm" not in path.parts:
            assert "heddle.llm" not in path.read_text(), path
