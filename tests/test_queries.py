"""Every query that has SQL agrees with it; the entry point runs."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry
from tarifa.plans import registry as price


@pytest.mark.parametrize("name", sorted(price.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert oracle.compare(spark, price.QUERIES[name], price.ORACLE_SQL[name], oracle.SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(price.QUERIES) - set(price.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    price.QUERIES[name](spark, oracle.MEDIUM).write.format("noop").mode("overwrite").save()


def test_stateful_query_on_more_rows(spark):
    """Groups that send nothing and products with several events in one second come only with more rows."""
    assert oracle.compare(spark, price.QUERIES["alerts_sent"], price.ORACLE_SQL["alerts_sent"], oracle.MEDIUM) == ""


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
