import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40


def test_a_missing_library_leaves_the_other_queries(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith(("quillmill.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quillmill.llm", None)
    queries = __spark_entry__.queries()
    assert "recognise_pipeline" in queries and not any(n.startswith("op") or n == "pipeline" for n in queries)
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
