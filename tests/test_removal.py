"""The rest works without the subpackage of training-data operators and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert e.oracle_sql().keys() <= q.keys() and 'rank_files' in q; print(*q)"


@pytest.mark.parametrize("gone", [("winnow/llm", "tests/llm"), ("winnow/llm", "tests/llm", "corpus_pipeline.py")])
def test_import_without_them(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".*cache"))
    for path in gone:
        if (copy / path).exists():
            shutil.rmtree(copy / path) if (copy / path).is_dir() else (copy / path).unlink()
    # without this repository, but with whatever else packages are found by
    others = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *others])}
    names = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert "pipeline" not in names and not any(n[:2] == "op" and n[2].isdigit() for n in names)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, env=env, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout[-2000:]
    some = [f"tests/test_queries.py::test_same_rows[{n}]" for n in ("rank_files", "merge_spans", "sha256")] + ["tests/test_sources.py::test_globs"]
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", *some], cwd=copy, env=env, capture_output=True, text=True)
    assert ran.returncode == 0 and f"{len(some)} passed" in ran.stdout, ran.stdout[-2000:]
