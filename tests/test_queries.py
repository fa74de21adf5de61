"""Every core query against its SQL, and those without SQL for a stable schema."""

import pytest
from conftest import DATA, compare

from cairn.plans import data_queries, evidence_queries, job_queries, more_queries, page_queries, registry, serving_queries

assert evidence_queries and job_queries and more_queries and page_queries and serving_queries


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    compare(spark, name, registry.QUERIES, registry.SQL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) | set(data_queries.QUERIES)))
def test_runs(spark, name):
    """Rows come out, the same ones in a second run. Brute force for these queries is in test_brute.py, test_serving.py and the like."""
    run = lambda: sorted(map(repr, (registry.QUERIES | data_queries.QUERIES)[name](spark, DATA).collect()))
    rows = run()
    assert rows == run() and (rows or name == "p3_resolved")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
