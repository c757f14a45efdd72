"""The library without its optional part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.abspath(os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
SHOW = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",), ("creditmill/llm/__pycache__/old.pyc",)])
def test_entry_without_the_training_operators(tmp_path, left):
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "creditmill"), copy / "creditmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    for name in left:
        (copy / name).parent.mkdir(parents=True, exist_ok=True)
        source = os.path.join(ROOT, name)
        (copy / name).write_bytes(open(source, "rb").read() if os.path.exists(source) else b"")
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    names, queries, oracles = done.stdout.rsplit(maxsplit=2)
    assert names == "[]" and int(queries) >= int(oracles) > 80
