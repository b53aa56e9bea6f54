"""The entry point holds all other queries where the training-data operators cannot be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import sys
for name in {blocked!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
from lexmill.plans import catalog
known = entry.queries()
assert set(catalog.queries()) <= set(known) and set(entry.oracle_sql()) <= set(known)
assert not any(name.startswith("op") or name == "pipeline" for name in known), sorted(known)
"""


@pytest.mark.parametrize("blocked", [("ahocorasick",), ("public_tokenizers",), ("lexmill.llm",), ("corpus_pipeline",)])
def test_queries_without_a_library(blocked):
    ran = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
