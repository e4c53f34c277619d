"""The driver's module must work without the optional parts."""

from __future__ import annotations

import importlib
import sys
from importlib.abc import MetaPathFinder

import pytest


class Absent(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("folioflow.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name.split(".queries")[0])
        return None


class Broken(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'something_else'", name="something_else")
        return None


@pytest.fixture
def fresh():
    hidden = {k: sys.modules.pop(k) for k in list(sys.modules) if k == "corpus_pipeline" or k.startswith("folioflow.llm") or k == "__spark_entry__"}
    finders = list(sys.meta_path)
    yield
    sys.meta_path[:] = finders
    sys.modules.pop("__spark_entry__", None)
    sys.modules.update(hidden)


def test_without_optional_parts(fresh):
    sys.meta_path.insert(0, Absent())
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert len(names) > 100 and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)


def test_other_errors_are_not_hidden(fresh):
    sys.meta_path.insert(0, Broken())
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("__spark_entry__")
