"""The entry without the training-data operators: left out, or without what they need."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.queries()) == sorted(e.oracle_sql()))"


def names() -> int:
    from verification.queries import queries

    return len(queries())


def asked(folder: Path, before: str = "") -> str:
    out = subprocess.run([sys.executable, "-c", before + ASK], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.strip()


@pytest.fixture()
def copy(tmp_path) -> Path:
    """The core alone, as it is after both folders and the pipeline have been deleted."""
    for name in ("sortfolio", "verification"):
        shutil.copytree(TOP / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_core_queries_stay_without_the_folder(copy):
    assert asked(copy) == f"{names()} True"


def test_core_queries_stay_beside_a_leftover_folder(copy):
    (copy / "sortfolio/llm/__pycache__").mkdir(parents=True)
    assert asked(copy) == f"{names()} True"


@pytest.mark.parametrize("missing", ["xxhash", "zstandard", "tokenizers", "sentencepiece"])
def test_core_queries_stay_without_what_the_others_need(missing):
    count, _ = asked(TOP, f"import sys; sys.modules[{missing!r}] = None; ").split()
    assert int(count) >= names()
