"""The driver's contract, and that no other part needs the llm subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_llm():
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name == "corpus_pipeline" or name.startswith("scriptorium.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 50 and not any(k.startswith("op") for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
