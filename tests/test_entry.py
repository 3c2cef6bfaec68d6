"""The entry without the corpus operators, as it is when their folders are gone."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("lakeloom/llm", "tests/llm"), ("lakeloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_operators(folder, gone):
    copy = pathlib.Path(folder) / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or str((pathlib.Path(d) / n).relative_to(ROOT)) in gone])
    assert not (copy / "lakeloom/llm").exists()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n.startswith('op') or n == 'pipeline' for n in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, sql, corpus = out.stdout.split()
    assert int(n) == int(sql) > 140 and corpus == "False"
