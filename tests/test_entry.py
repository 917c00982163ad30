"""The entry module without the training-corpus folders, and without its pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def imported(folder: Path) -> str:
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q), set(e.oracle_sql()) <= set(q))"
    env = {**os.environ, "PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True, timeout=120).stdout.strip()


def test_entry_imports_without_the_corpus_folders(tmp_path):
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git")
    shutil.copytree(ROOT / "policylake", tmp_path / "policylake", ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    count, pipeline, numbered, covered = imported(tmp_path).split()
    assert int(count) > 200 and (pipeline, numbered, covered) == ("False", "False", "True")
    (tmp_path / "corpus_pipeline.py").write_text("import policylake.llm\n")
    assert imported(tmp_path).split()[1] == "False"
