"""The driver's entry with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SEE = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("gone", [("kodegraf/llm", "tests/llm"), ("kodegraf/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_operators(tmp_path, gone):
    for name in ("kodegraf", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", SEE], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert run.returncode == 0, run.stderr
    n, dealt = map(int, run.stdout.split())
    assert n - dealt >= 128
    if "kodegraf/llm" in gone:
        assert dealt == 0
        tests = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True)
        assert tests.returncode == 0, tests.stdout


def test_broken_operators_are_no_missing_ones(tmp_path):
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    shutil.copytree(ROOT / "kodegraf", tmp_path / "kodegraf", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    run = subprocess.run([sys.executable, "-c", SEE], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert "no_such_module" in run.stderr and run.returncode
