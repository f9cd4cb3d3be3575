import importlib.util

import __spark_entry__ as entry


def test_entry_and_names(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 8 and {r.damage for r in rows} == set(range(8))
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert any(k.startswith("op") for k in entry.queries()) == (importlib.util.find_spec("vellum.llm") is not None)
