"""The library stands without the folders that may be deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
PROGRAM = """
import __spark_entry__ as entry
from corpusloom.session import build
names = entry.queries().keys()
assert len(names) > 100 and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert entry.oracle_sql().keys() <= names
print("rows", entry.entry(build(master="local[2]", partitions=2, app="standing")).count())
"""


@pytest.mark.parametrize("gone", [("corpusloom/llm", "tests/llm"), ("corpusloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_llm(gone, tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=lambda folder, names: {n for n in names if n in (".git", "__pycache__", ".pytest_cache") or str((Path(folder) / n).relative_to(REPO)) in gone})
    for name in gone:
        assert not (copy / name).exists()
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows " in done.stdout, done.stderr[-2000:]
