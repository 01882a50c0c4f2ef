"""The entry without the folders that may be taken away."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op1_') for q in e.queries()))"


@pytest.mark.parametrize("gone", [("lexivane/llm",), ("lexivane/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without(folder, gone):
    if not os.path.isdir(f"{ROOT}/lexivane/llm"):
        pytest.skip("the folder is gone already")
    shutil.copytree(f"{ROOT}/lexivane", f"{folder}/lexivane", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/{name}", folder)
    for name in gone:
        path = f"{folder}/{name}"
        shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=60)
    n, pipeline, llm = out.stdout.split()
    assert int(n) >= 80 and pipeline == "False" and llm == str("lexivane/llm" not in gone), out.stderr
