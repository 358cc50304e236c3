"""Every registered query against its SQL, and the entry points."""

from __future__ import annotations

import pytest
from oracle import connect, differences

import __spark_entry__ as entry_points
from drayage.plans.catalog import load_all

QUERIES = load_all()
WITH_SQL = [name for name, q in QUERIES.items() if q.sql is not None]
WITHOUT_SQL = [name for name, q in QUERIES.items() if q.sql is None]


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", WITH_SQL)
def test_agrees_with_sql(spark, folder, con, name):
    assert differences(QUERIES[name].run(spark, folder), con, QUERIES[name].sql) == []


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_has_rows(spark, folder, name):
    assert not QUERIES[name].run(spark, folder).isEmpty()


def test_few_queries_lack_sql():
    assert set(WITHOUT_SQL) == {"file_inventory", "scan_text_prefix"}


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert not entry_points.entry(spark).isEmpty()
