"""Reports over every company, not over one or over the first rows of all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelex import catalog
from tidelex.plans.bindings import scored


@pytest.mark.parametrize("name", ["absent_but_high_by_company", "axis_overlay_by_company"])
def test_every_company(spark, middle, check_sql, name):
    found = catalog.QUERIES[name](spark, middle)
    check_sql(found, catalog.ORACLE_SQL[name], middle)
    rows = scored(spark, middle, "inclusion")
    if name.startswith("absent"):
        rows = rows.where("vec_id % 2 = 1 AND score > 0.2")
        want = {r.company: r.n for r in rows.groupBy("company").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert {r.company: r.n_rows for r in found.collect()} == want
    assert {r.company for r in found.collect()} == {r.company for r in rows.select("company").distinct().collect()}
