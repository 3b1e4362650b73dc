"""The driver's entry points."""

from __future__ import annotations

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_imports_nothing_of_llm():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "casemill"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"casemill\.llm|import llm", path.read_text()), path
