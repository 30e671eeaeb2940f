"""Inventory rows that were once missing are claimed by a query with SQL to check it."""

import pytest

from candlewick.plans import registry


@pytest.mark.parametrize("row", ["D8", "L4", "I11", "C4", "G19", "G20", "J10", "M2"])
def test_row_is_claimed(row):
    import __spark_entry__  # noqa: F401

    claiming = [q for q in registry.QUERIES.values() if row in q.covers.split()]
    assert claiming and any(q.sql for q in claiming)
