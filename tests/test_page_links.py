"""Links of a page beyond the fourth, and the shipped content pattern."""

from __future__ import annotations

import pytest

from tidelex import catalog
from tidelex.functions.html import link_pages

HREFS = ["/teams", "/jobs/12", "/plain", "/en/culture", "/teams", *(f"/about/{c}" for c in "abcdefghij"), "/values.pdf"]
CONTENT = [h for h in dict.fromkeys(HREFS) if h in ("/teams", "/en/culture") or h.startswith("/about")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("links")
    html = "<html><body>" + "".join(f'<p><a href="{h}">x</a></p>' for h in HREFS) + "</body></html>"
    frame = spark.createDataFrame([(1, "http://example.com/a", html), (2, "http://example.org/b", "<p>none</p>")], "page_id long, url string, html string")
    frame.toPandas().to_parquet(path / "pages.parquet")
    return str(path)


@pytest.mark.parametrize("name,wanted", [("page_content_links", CONTENT[:10]), ("page_links", [h for h in dict.fromkeys(HREFS) if h.rsplit("/", 1)[1].isalpha()][:10])])
def test_ten_links(spark, folder, name, wanted):
    import duckdb

    rows = catalog.QUERIES[name](spark, folder).select("page_id", "url", "position").collect()
    assert [r.url for r in sorted(rows, key=lambda r: r.position)] == ["http://example.com" + h for h in wanted] and len(rows) == 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    assert sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall()) == sorted(map(tuple, rows))


def test_smaller_cap(spark, folder):
    rows = link_pages(spark.read.parquet(f"{folder}/pages.parquet"), ["example.com"], cap=4).collect()
    assert [r.url for r in rows] == ["http://example.com" + h for h in CONTENT[:4]]


def test_same_as_sql_on_the_fixture(spark, middle, check_sql):
    found = catalog.QUERIES["page_links"](spark, middle)
    check_sql(found, catalog.ORACLE_SQL["page_links"], middle)
    assert found.where("position >= 4").count() == 16
