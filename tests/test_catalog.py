"""Every registered query against its SQL, and the driver's entry points."""

from __future__ import annotations

import pytest

import __spark_entry__
from tidelex import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, small, check_sql, name):
    check_sql(catalog.QUERIES[name](spark, small), catalog.ORACLE_SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, small, name):
    frame = catalog.QUERIES[name](spark, small)
    assert frame.count() > 0 and len(frame.columns) == len(set(frame.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(catalog.QUERIES) <= set(names)
