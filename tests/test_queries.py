"""Every registered query of the engine against its SQL."""

import pytest
from compare import connect, differ

from millrace.plans import registry


def test_queries_without_sql():
    """Only an approximate search has none; its recall is tested beside it."""
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"vector_cells_topk"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf, name):
    assert differ(spark, connect(sf), registry.QUERIES[name], registry.ORACLES[name], sf) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_topk_plan(spark, sf):
    """Top-k is a bounded heap, and the scan reads only what the query needs."""
    plan = registry.QUERIES["lexical_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = registry.QUERIES["vector_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
