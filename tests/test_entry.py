"""The driver's contract, with the corpus operators and without them."""

import os
import subprocess
import sys

import __spark_entry__ as entry

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    rows = {r["clause"]: r["rows_affected"] for r in entry.entry(spark).collect()}
    assert len(rows) == 6 and rows["modify l_quantity"] == 0 and rows["add key PRIMARY"] > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())


def test_entry_without_the_corpus_operators(tmp_path):
    for name in os.listdir(TOP):
        if name not in ("corpus_pipeline.py", "plumbline", ".git"):
            os.symlink(os.path.join(TOP, name), tmp_path / name)
    os.mkdir(tmp_path / "plumbline")
    for name in os.listdir(os.path.join(TOP, "plumbline")):
        if name != "llm":
            os.symlink(os.path.join(TOP, "plumbline", name), tmp_path / "plumbline" / name)
    said = subprocess.run([sys.executable, "-c", "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    n, pipeline = said.stdout.split()
    assert int(n) > 90 and pipeline == "False", said.stderr
