"""Saved index answers, filing indexes, selection within years and published tables."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidelex.operators import captures
from tidelex.sources import publish, publish_manifest, published, read_filing_blocks, read_index_answers

HEAD = ["urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length"]


def capture(url, ts, status="200", digest="d", length="10"):
    return [url.split("//")[1], ts, url, "text/html", status, digest, length]


@pytest.fixture
def answers(tmp_path):
    def put(match, site, since, until, name, rows):
        folder = tmp_path / "answers" / f"match_type={match}" / f"site={site}" / f"since={since}" / f"until={until}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(rows if isinstance(rows, str) else json.dumps([HEAD, *rows]) if rows else "[]")

    put("exact", "acme", 2005, 2010, "a.json", [capture("http://acme.com/jobs", "20060103000000"), capture("http://acme.com/jobs", "20060120000000"), capture("http://www.acme.com/jobs/", "20100203000000", length=None), capture("http://acme.com/jobs", "20070101000000", "301")])
    put("prefix", "acme", 2011, 2020, "b.json", [capture("http://acme.com/jobs/1", "20120101000000"), capture("http://acme.com/about", "20120101000000"), capture("http://jobs.acme.com/", "20130101000000")])
    put("prefix", "acme", 2011, 2020, "c.json", [])
    return put, str(tmp_path / "answers")


def found(rows):
    return sorted((r.original, r.timestamp, r.length) for r in rows.collect())


def test_index_answers(spark, answers):
    _, folder = answers
    assert found(read_index_answers(spark, folder, "http://acme.com/jobs", "exact")) == [("http://acme.com/jobs", "20060103000000", 10), ("http://www.acme.com/jobs/", "20100203000000", 0)]
    assert found(read_index_answers(spark, folder, "http://acme.com/jobs", "exact", monthly=False, status=None, to_ts="2007")) == [("http://acme.com/jobs", t, 10) for t in ("20060103000000", "20060120000000", "20070101000000")]
    assert found(read_index_answers(spark, folder, "http://acme.com/jobs", "exact", from_ts="200602", to_ts="20100203")) == [("http://www.acme.com/jobs/", "20100203000000", 0)]
    assert found(read_index_answers(spark, folder, "acme.com/jobs", "prefix")) == [("http://acme.com/jobs/1", "20120101000000", 10)]
    assert read_index_answers(spark, folder, from_ts="2011").count() == 3 and read_index_answers(spark, folder).count() == 5


@pytest.mark.parametrize(("match", "n"), [("host", 2), ("domain", 3)])
def test_hosts(spark, answers, match, n):
    put, folder = answers
    put(match, "acme", 2005, 2020, "d.json", [capture("http://acme.com/a", "20120101000000"), capture("http://www.acme.com/b", "20120101000000"), capture("http://jobs.acme.com/", "20130101000000"), capture("http://notacme.com/", "20130101000000")])
    assert read_index_answers(spark, folder, "http://acme.com", match).count() == n


def test_ruled_out_files_are_not_opened(spark, answers):
    put, folder = answers
    plan = lambda rows: (rows.collect(), rows._jdf.queryExecution().executedPlan().toString())[1]
    rows = read_index_answers(spark, folder, match_type="exact", to_ts="2010", monthly=False)
    assert "PartitionFilters: [" in plan(rows)

    def opened(rows):
        """Files read, from the scan's own count."""
        rows.collect()
        node = rows._jdf.queryExecution().executedPlan()
        leaves = node.executedPlan().collectLeaves() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        while any(s.getClass().getSimpleName().endswith("QueryStageExec") for s in scans):
            scans = [x for s in scans for x in ([s.plan().collectLeaves().apply(i) for i in range(s.plan().collectLeaves().size())] if s.getClass().getSimpleName().endswith("QueryStageExec") else [s])]
        return sum(s.metrics().apply("numFiles").value() for s in scans)

    assert opened(read_index_answers(spark, folder, monthly=False)) == 3
    assert opened(rows) == 1
    assert opened(read_index_answers(spark, folder, from_ts="2011", monthly=False)) == 2


def block(*filings):
    return dict(zip(("form", "accessionNumber", "filingDate", "primaryDocument"), map(list, zip(*filings, strict=True)), strict=True))


def test_filing_indexes(spark, tmp_path):
    """Historical files that a company's file names are read, others not; years before 2010 and other forms are left out."""
    put = lambda name, data: (tmp_path / name).write_text(json.dumps(data, indent=1))
    put("CIK0000000007.json", {"cik": "7", "filings": {"recent": block(("10-K", "0-21-1", "2021-02-01", "a.htm"), ("8-K", "0-21-2", "2021-03-01", "b.htm"), ("10-K", "0-21-3", "2021-11-01", "c.htm")), "files": [{"name": "CIK0000000007-submissions-001.json"}]}})
    put("CIK0000000007-submissions-001.json", block(("10-K", "0-12-1", "2012-02-01", "d.htm"), ("10-K", "0-09-1", "2009-02-01", "e.htm")))
    put("CIK0000000007-submissions-002.json", block(("10-K", "0-13-1", "2013-02-01", "f.htm")))
    put("CIK0000000008.json", {"cik": "8", "filings": {"recent": block(("10-K", "0-20-1", "2020-02-01", "g.htm")), "files": []}})
    latest = captures.latest_filing_per_year(read_filing_blocks(spark, str(tmp_path)), ["cik"])
    assert sorted((r.cik, r.year, r.primaryDocument) for r in latest.collect()) == [("7", 2012, "d.htm"), ("7", 2021, "c.htm"), ("8", 2020, "g.htm")]
    rows = captures.last_filings(latest, "cik", 1, "https://a.example/data").collect()
    assert sorted((r.cik, r.source_url) for r in rows) == [("0000000007", "https://a.example/data/7/0213/c.htm"), ("0000000008", "https://a.example/data/8/0201/g.htm")]


def test_filings_of_all_years(spark, middle, check_sql):
    """The query has the reports of 2009 too, which the operator leaves out unless it is told to take all years."""
    from tidelex.catalog import ORACLE_SQL, QUERIES

    got = QUERIES["latest_filings"](spark, middle)
    assert got.agg(F.min("year")).first()[0] < captures.FIRST_FILING_YEAR
    check_sql(got, ORACLE_SQL["latest_filings"], middle)


def picked(rows, per_year):
    """The greedy choice row by row, on (timestamp, id) pairs of one year."""
    rows = sorted(rows)
    if len(rows) <= per_year:
        return rows
    left, taken = list(rows), []
    for i in range(per_year):
        m = round((i + 0.5) * 12 / per_year)
        best = min(left, key=lambda r: (abs(int(r[0][4:6]) - m), left.index(r)))
        left.remove(best)
        taken.append(best)
    return sorted(taken)


@pytest.mark.parametrize("per_year", [1, 3, 4, 6])
def test_greedy_selection(spark, per_year):
    rnd = random.Random(per_year)
    rows = [(f"u{rnd.randrange(6)}", f"{rnd.choice([2010, 2011])}{rnd.choice([1, 2, 2, 5, 8, 12]):02d}{rnd.randint(1, 28):02d}000000", k, "x") for k in range(150)]
    frame = spark.createDataFrame(rows, "urlkey string, timestamp string, id int, row string").repartition(5)
    got = {}
    for r in captures.select_per_year(frame, ["urlkey"], ["id"], per_year).collect():
        got.setdefault((r.urlkey, r.year), []).append((r.timestamp, r.id))
    want = {}
    for u, t, k, _ in rows:
        want.setdefault((u, int(t[:4])), []).append((t, k))
    assert {g: sorted(v) for g, v in got.items()} == {g: picked(v, per_year) for g, v in want.items()}


def manifest(spark, path):
    return {r.company: (r.display_name, r.axes) for r in published(spark, path).collect()}


def test_manifest_entries_replace_their_own(spark, tmp_path):
    path = str(tmp_path / "companies")
    make = lambda *rows: spark.createDataFrame(rows, "company string, display_name string, axes array<string>")
    publish_manifest(make(("a", "Alpha", ["control", "altruism"]), ("b", "Beta", ["altruism"])), path)
    publish_manifest(make(("b", "Beta Inc", ["dei", "control"])), path)
    assert manifest(spark, path) == {"a": ("Alpha", ["altruism"]), "b": ("Beta Inc", ["altruism", "dei"])}
    publish_manifest(make(("b", "Beta", ["trust"]), ("c", "Gamma", [])), path, replace=True)
    assert manifest(spark, path) == {"a": ("Alpha", ["altruism"]), "b": ("Beta", ["trust"]), "c": ("Gamma", [])}


def test_interleaved_and_failed_writers(spark, tmp_path):
    """Two writers whose reads both come first keep each other's entries; a writer that fails half way leaves the old entry."""
    path = str(tmp_path / "series")
    rows = lambda c, v: spark.createDataFrame([(c, y, v) for y in (2010, 2011)], "company string, year int, value double")
    publish(rows("a", 1.0).unionByName(rows("b", 1.0)), path, ["company"])
    read = lambda: sorted((r.company, r.year, r.value) for r in published(spark, path, "company string, year int, value double").collect())
    seen = published(spark, path, "company string, year int, value double")
    first, second = seen.where("company = 'a'").withColumn("value", F.col("value") + 1), seen.where("company = 'b'").withColumn("value", F.col("value") + 2)
    publish(first, path, ["company"])
    publish(second, path, ["company"])
    assert read() == [("a", 2010, 2.0), ("a", 2011, 2.0), ("b", 2010, 3.0), ("b", 2011, 3.0)]
    broken = rows("a", 9.0).withColumn("value", F.when(F.col("year") == 2011, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        publish(broken, path, ["company"])
    assert read() == [("a", 2010, 2.0), ("a", 2011, 2.0), ("b", 2010, 3.0), ("b", 2011, 3.0)]
