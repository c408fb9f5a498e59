"""The driver's entry points."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names_match():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 50


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    for path in ROOT.glob("tessella/**/*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    assert "llm" not in ast.unparse(node)
