"""The entry works without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith(('op', 'pipe')) for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join([str(folder), *sys.path])})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "evispark", tmp_path / "evispark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    here = tmp_path
    assert names(here)[2] == "False"
    if (ROOT / "corpus_pipeline.py").exists():  # left behind, it isn't imported
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        assert names(here)[2] == "False"
