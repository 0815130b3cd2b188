"""Readers and writers against small files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tidelex import sources
from tidelex.operators.joins import joined_in_blocks


def test_chunks_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for year in (2011, 2010):
        rows = [{"chunk_id": f"{year}-{k}", "text": "é" * k, "year": year, "position": k} for k in range(2)]
        (tmp_path / "in" / f"{year}.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    read = sources.read_chunks(spark, str(tmp_path / "in"))
    assert [r.chunk_id for r in read.orderBy("file", "position").collect()] == ["2010-0", "2010-1", "2011-0", "2011-1"]
    sources.write_chunks(read.drop("file"), str(tmp_path / "out"))
    assert spark.read.schema(sources.CHUNK).json(str(tmp_path / "out")).count() == 4


def test_labels_profiles_and_maps(spark, tmp_path):
    (tmp_path / "l.csv").write_text('chunk_id,text,label\na,"two\nlines, ""quoted""", mission \nb,x,\nc,y,  \n')
    rows = sources.read_labels(spark, str(tmp_path / "l.csv"), "chunk_id string, text string, label string", "label").collect()
    assert [(r.chunk_id, r.text, r.label) for r in rows] == [("a", 'two\nlines, "quoted"', "mission")]
    (tmp_path / "p.json").write_text(json.dumps({"company": "acme", "validation": {"expected_altruism_peak": 2014}, "patterns": [{"url": "acme.com/jobs", "match_type": "exact"}], "alt_domains": [{"url": "acme.org", "match_type": "prefix", "era_hint": "late"}]}))
    (tmp_path / "q.json").write_text(json.dumps({"company": "beta", "display_name": "BETA"}))
    got = {r.company: r for r in sources.read_profiles(spark, [str(tmp_path / "p.json"), str(tmp_path / "q.json")]).collect()}
    assert got["acme"].display_name == "Acme" and got["acme"].validation.tolerance == 2 and got["beta"].display_name == "BETA" and got["beta"].validation is None
    assert [tuple(x) for x in got["acme"].patterns] == [("acme.com/jobs", "exact", None)] and got["acme"].alt_domains[0].era_hint == "late" and got["beta"].alt_domains == got["acme"].spa_json_probes == []
    (tmp_path / "m.json").write_text(json.dumps({"a": "x", "b": "y"}, indent=2))
    assert {tuple(r) for r in sources.label_map(spark, str(tmp_path / "m.json")).collect()} == {("a", "x"), ("b", "y")}


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "cache")
    for low, high in ((0, 5), (3, 8)):
        sources.append_new(spark.range(low, high).select("id", F.lit(low).alias("run")), path, ["id"])
    assert sorted((r.id, r.run) for r in spark.read.parquet(path).collect()) == [(k, 0 if k < 5 else 3) for k in range(8)]


def test_axes(spark, tmp_path):
    (tmp_path / "a.yaml").write_text('name: warm\npole_a:\n  label: hot\n  sentences: ["é one", two]\npole_b:\n  label: cold\n  sentences: [three]\n')
    (tmp_path / "b.yaml").write_text("name: lone\npole_a: {label: only, sentences: [four]}\npole_b:\n")
    rows = sources.read_axes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("lone", True, "a", "only", 0, "four"), ("warm", False, "a", "hot", 0, "é one"), ("warm", False, "a", "hot", 1, "two"), ("warm", False, "b", "cold", 0, "three")]


def test_manual_captures(spark, tmp_path):
    (tmp_path / "p.html").write_bytes(b"<p>x</p>")
    listed = [("p.html", "http://a", "20100203", None), ("p.html", "http://b", "20100203040506", "mail"), ("gone.html", "http://c", "20100203", None)]
    got = {r.original: r for r in sources.manual_captures(spark, str(tmp_path), spark.createDataFrame(listed, sources.MANUAL)).collect()}
    digest = hashlib.sha256(b"<p>x</p>").hexdigest()[:24]
    assert sorted(got) == ["http://a", "http://b"] and {r.digest for r in got.values()} == {digest}
    assert got["http://a"].html_file == f"20100203120000_{digest}.html" and got["http://a"].source == "manual" and got["http://b"].timestamp == "20100203040506"


def test_series_of_both_forms(spark, tmp_path):
    year = lambda z: [{"year": 2010, "zscore": z}]
    for name, body in {"flat": {"years": year(1.0)}, "both": {"levels": {"sentence": {"years": year(2.0)}, "chunk": {"years": year(3.0)}}}, "old": {"levels": {"chunk": {"years": year(4.0)}}}, "none": {}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"company": name, "axis": "x", **body}, indent=2))
    assert {r.company: r.zscore for r in sources.read_series(spark, str(tmp_path)).collect()} == {"flat": 1.0, "both": 2.0, "old": 4.0}


def test_documents_and_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("a", "é", [1, 2]), ("b", None, [])], "company string, name string, years array<int>")
    sources.write_documents(rows, str(tmp_path / "web"), ["company"])
    (one,) = (tmp_path / "web" / "company=a").glob("part-*")
    assert json.loads(one.read_text()) == {"name": "é", "years": [1, 2]} and "é" in one.read_text() and "\n" in one.read_text().strip()
    sources.write_sheet(rows.select("company", F.lit('a "b"\nc').alias("text")), str(tmp_path / "sheet"))
    sheet = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "sheet"))
    assert sorted(map(tuple, sheet.collect())) == [("a", 'a "b"\nc', None), ("b", 'a "b"\nc', None)]
    assert sources.read_labels(spark, str(tmp_path / "sheet"), "company string, text string, label string", "label").count() == 0


def test_review(spark, tmp_path):
    rows = spark.createDataFrame([(2011, 1, "", "p"), (2010, 2, "H", "q"), (2010, 1, None, None)], "year int, position int, heading string, text string")
    sources.write_review(sources.review_lines(rows, ["position"]), str(tmp_path / "review"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "review").glob("part-*")))
    assert text.split("\n\n") == ["## 2010 (2 chunks)", "- ", "- **H** — q", "## 2011 (1 chunks)", "- p", ""]


def test_joins_in_blocks(spark):
    few = spark.range(0, 25, 1, 3).withColumnRenamed("id", "y")
    whole = joined_in_blocks(spark.range(7), few, F.col("y") % 7 >= F.col("id"))
    parts = joined_in_blocks(spark.range(7), few, F.col("y") % 7 >= F.col("id"), most=4)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) == sorted((x, y) for x in range(7) for y in range(25) if y % 7 >= x)
