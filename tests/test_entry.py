import importlib
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "token", "w"] and df.limit(5).count() == 5


def test_queries_have_sql_of_their_own():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 130 and len(sql) > 110


def test_the_rest_works_without_the_llm_subpackage(monkeypatch):
    class Hide:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("corpusloom.llm"):
                raise ModuleNotFoundError(name, name=name)

    for name in [n for n in sys.modules if n.startswith("corpusloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(sys.modules["corpusloom"], "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Hide(), *sys.meta_path])
    m = importlib.reload(entry)
    try:
        assert m.llm_queries is None and "pipeline" not in m.queries() and "tfidf_vectors" in m.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
