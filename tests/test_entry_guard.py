"""The entry leaves the operators for training data out only if they are not installed."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("No module named " + name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
assert "flagship_mart" in entry.queries() and "pipeline" not in entry.queries()
"""


@pytest.mark.parametrize("name, works", [
    ("corpus_pipeline", True), ("gatewell.llm", True), ("gatewell.session", False)])
def test_what_may_be_missing(name, works):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(name=name)], cwd=ROOT,
                          capture_output=True, text=True)
    assert (done.returncode == 0) == works, done.stderr
