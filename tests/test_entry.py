"""The driver's contract without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_training_data_operators():
    code = ("import sys; sys.modules['gatewell.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e\n"
            "assert 'flagship_mart' in e.queries() and 'flagship_mart' in e.oracle_sql()\n"
            "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "gatewell").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "gatewell.llm" not in path.read_text(), path
