"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare

from tidemark.plans.catalog import REGISTRY


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_agrees_with_sql(spark, data, name):
    entry = REGISTRY[name]
    assert entry.sql is not None
    ok, note = compare(spark, entry, data)
    assert ok, note


def test_entry_points(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    row = e.entry(spark).collect()[0]
    # Neither side of the split is empty, else the totals would prove nothing.
    assert row.lake_count > 0 and row.ch_count > 0 and row.watermark_t_ms > 0
    assert row["count"] == row.lake_count + row.ch_count
    assert row.gmv == row.lake_gmv + row.ch_gmv
