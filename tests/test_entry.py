"""The driver's entry points, with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [[], ["curvelake/llm", "tests/llm"], ["curvelake/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_imports(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and all(map(callable, q.values())); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": f"{copy}:{os.environ.get('PYTHONPATH', '')}"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 100
