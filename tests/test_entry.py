"""The entry points without the operators for training data, in a copy of the repository."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import sys; {}; import __spark_entry__ as e; q = e.queries(); assert 'grep_literal' in q and set(e.oracle_sql()) <= set(q); print(any(x.startswith('op') for x in q))"


def imported(folder, before="pass"):
    done = subprocess.run([sys.executable, "-c", CODE.format(before)], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return done.stdout.strip() == "True"


@pytest.fixture
def copy(tmp_path):
    for name in ("linescan", "__spark_entry__.py", "corpus_pipeline.py"):
        at = os.path.join(ROOT, name)
        if os.path.isdir(at):
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(at):
            shutil.copy(at, tmp_path)
    return tmp_path


def test_without_the_subpackage(copy):
    shutil.rmtree(copy / "linescan" / "llm", ignore_errors=True)
    assert not imported(copy)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert not imported(copy)


def test_with_what_is_left_of_the_subpackage(copy):
    shutil.rmtree(copy / "linescan" / "llm", ignore_errors=True)
    (copy / "linescan" / "llm" / "__pycache__").mkdir(parents=True)
    assert not imported(copy)


@pytest.mark.parametrize("library", ["zstandard", "tiktoken"])
def test_without_a_library_of_theirs(copy, library):
    assert not imported(copy, f"sys.modules[{library!r}] = None")
