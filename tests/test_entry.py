"""The driver's entry points, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
TOLD = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q) and 'rk01_pagerank_top_suppliers' in q; print(len([k for k in q if k == 'pipeline' or k.startswith('op')]))"


@pytest.mark.parametrize("gone", [("latticework/llm", "tests/llm"), ("latticework/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        elif (copy / name).exists():
            (copy / name).unlink()
    done = subprocess.run([sys.executable, "-c", TOLD], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0 and done.stdout.strip() == "0", done.stderr


def test_every_definition_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
