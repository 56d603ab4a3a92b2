"""The entry file works without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("without", [("tallywatch/llm",), ("tallywatch/llm", "corpus_pipeline.py")])
def test_imports_without_the_corpus_operators(tmp_path, without):
    left_out = [os.path.join(ROOT, w) for w in without]

    def ignore(folder, names):
        return [n for n in names if n in ("__pycache__", ".git") or os.path.join(folder, n) in left_out]

    shutil.copytree(ROOT, tmp_path / "tree", ignore=ignore)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "tree", capture_output=True, text=True, check=True)
    count, optional = out.stdout.split()
    assert int(count) > 90 and optional == "False"
