"""The driver's entry: every SQL has its query, and the core loads where the training-data operators can't be imported."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def _run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip()


def test_every_sql_has_a_query():
    assert _run("import __spark_entry__ as e; print(set(e.oracle_sql()) - set(e.queries()))") == "set()"


def test_core_loads_alone():
    names = _run("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(' '.join(e.queries()))").split()
    assert len(names) > 100 and not any(n.startswith("op") or n == "pipeline" for n in names)
