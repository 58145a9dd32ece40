"""The engine imports and registers its queries without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("strandlog.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "live_state" in e.queries() and "pipeline" not in e.queries() and not any(n.startswith("op") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_llm():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=120)


def test_a_copy_without_the_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; assert 'live_state' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0, found.stdout[-2000:]


def test_engine_never_names_llm():
    for p in (ROOT / "strandlog").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text()
