"""The rest works without the subpackage, and nothing outside of it imports it."""

import re
import subprocess
import sys

from conftest import ROOT


def test_nothing_else_imports_llm():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"tidemark\.llm|from \.+llm|import corpus_pipeline", path.read_text()), path


def test_entry_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "tidemark"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
