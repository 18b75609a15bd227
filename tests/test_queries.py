from __future__ import annotations

import oracle
import pytest

from driftwise.plans import registry


@pytest.fixture(scope="module")
def connection(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, folder, connection, name):
    assert oracle.difference(registry.QUERIES[name](spark, folder), connection, registry.SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["mismatch_type", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
