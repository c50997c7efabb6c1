import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[2]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    assert rows and {r.severity for r in rows} <= {"medium", "high"}


def test_without_llm(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "plantflow", tmp_path / "plantflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[0]) > 50 and said.stdout.split()[1] == "False"


def test_nothing_else_imports_llm():
    for path in (ROOT / "plantflow").rglob("*.py"):
        if "llm" not in path.parts:
            assert "plantflow.llm" not in path.read_text() and "from ..llm" not in path.read_text()
