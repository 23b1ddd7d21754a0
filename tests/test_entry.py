"""The driver's entry points."""

import __spark_entry__ as entry


def test_names_and_oracles(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_optional_parts_may_be_absent(monkeypatch):
    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert "detect_multi_rule" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
