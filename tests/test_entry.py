"""The driver's contract."""

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 120


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "close" in rows.columns
