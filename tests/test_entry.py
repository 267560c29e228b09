import importlib
import sys

import pytest


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["h", "agents", "versions", "rewrites", "alive", "first_k"]


def test_entry_without_the_optional_part(monkeypatch):
    """The engine's own queries stay when the optional subpackage is removed."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("stemmata.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("stemmata.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import stemmata

    monkeypatch.delattr(stemmata, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    import __spark_entry__ as e

    e = importlib.reload(e)
    assert e.queries() and all(n.startswith("q") for n in e.queries())


@pytest.fixture(autouse=True)
def again():
    yield
    import __spark_entry__ as e

    importlib.reload(e)
