"""The entry works without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "quarrymill", tmp_path / "quarrymill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 40, done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quarrymill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quarrymill.llm" not in path.read_text(), path
