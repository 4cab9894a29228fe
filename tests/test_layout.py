"""The corpus operators are an optional part: nothing else imports them."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "sessionloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"sessionloom\.llm|from \.+llm|corpus_pipeline", path.read_text()), path


def test_entry_imports_without_them(tmp_path):
    shutil.copytree(ROOT / "sessionloom", tmp_path / "sessionloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
