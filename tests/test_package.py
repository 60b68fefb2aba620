"""The library holds together without its optional subpackage."""

import re
import runpy
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "statuta").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_entry_works_without_the_subpackage_or_what_it_needs(monkeypatch):
    for absent in ("statuta.llm", "regex", "public_tokenizers"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith(("statuta.llm", "corpus_pipeline"))]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, absent, None)
            found = runpy.run_path(str(ROOT / "__spark_entry__.py"))
        assert not [n for n in found["queries"]() if n.startswith("op") or n == "pipeline"] and len(found["queries"]()) > 90
        assert set(found["oracle_sql"]()) <= set(found["queries"]())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_flagship_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
