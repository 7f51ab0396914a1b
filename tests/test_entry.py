from __future__ import annotations

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["l_returnflag", "l_linestatus", "n", "sum_qty", "avg_disc", "lo", "hi"]


def test_names_are_registered():
    assert len(entry.queries()) >= 100 and set(entry.oracle_sql()) <= set(entry.queries())
