"""Filings by hand: sections, chunks of whole sentences, and ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidelex.functions.html import chunk_filings, chunk_pages, filing_chunks, filing_text, filing_texts
from tidelex.functions.text import filing_sections


def sentence(n: int, name: str = "w") -> str:
    return " ".join(f"{name}{k}" for k in range(n - 1)) + " end."


def test_chunks_of_whole_sentences():
    a, b, c = sentence(30), sentence(230, "b"), sentence(20, "c")
    assert filing_chunks(f"{a}\n\n {b}  {c}") == [f"{a} {b}"]  # 30 words go on beyond 250; a rest of 20 is dropped
    assert filing_chunks(f"{sentence(45)} {b} {sentence(40, 'd')}") == [sentence(45), b, sentence(40, "d")]
    assert filing_chunks(sentence(250)) == [sentence(250)] and filing_chunks(sentence(39)) == [] and filing_chunks("") == []
    assert filing_chunks(" ".join(sentence(10, f"s{k}") for k in range(26))) == [" ".join(sentence(10, f"s{k}") for k in range(25))]


def test_sections(spark):
    texts = {
        "both": "x Human Capital Management we hire. Available Information ... ITEM 1A. RISK\nFACTORS bad things ITEM 1B. end",
        "culture first": "Human Capital early Item 1A ... Culture and Workforce people Government Regulation",
        "business only": "ITEM 1. BUSINESS we sell. ITEM 1A. nothing",
        "no-break spaces": "ITEM\u00a01A.\u00a0RISK\u00a0FACTORS many ITEM\u20031B.\u00a0x",
        "none": "plain words", "null": None,
    }
    rows = spark.createDataFrame(list(texts.items()), "name string, t string").select("name", F.explode(filing_sections(F.col("t"))).alias("s")).collect()
    assert {(r["name"], r.s.section, r.s.text) for r in rows} == {
        ("both", "Human Capital", "we hire."), ("both", "Risk Factors", "bad things"), ("culture first", "Human Capital", "people"), ("business only", "Business", "we sell."), ("no-break spaces", "Risk Factors", "many"),
    }
    assert spark.createDataFrame([("Human Capital " + "é" * 20_000 + " Item 1A",)], "t string").select(F.length(filing_sections(F.col("t"))[0]["text"]).alias("n")).first().n == 12_000


def test_ids(spark):
    text = sentence(60)
    row = chunk_filings(spark.createDataFrame([(7, 2021, "Business", text), (8, 2021, "Business", None)], "filing_id long, year int, section string, text string")).collect()
    assert [(r.chunk_id, r.timestamp, r.position) for r in row] == [(hashlib.sha256(f"2021:Business:0:{text}".encode()).hexdigest()[:16], "20210101000000", 0)]
    pages = spark.createDataFrame([(1, "http://a.example/x", f"<p>{sentence(60)}</p>", "20140304000000")], "page_id long, url string, html string, timestamp string")
    page = chunk_pages(pages).collect()
    assert page[0]["chunk_id"] == hashlib.sha256(f"20140304000000|http://a.example/x|0|{sentence(60)}".encode()).hexdigest()[:16]
    assert (page[0]["year"], page[0]["extraction_source"]) == (2014, "dom")


HTML = {
    "<p>ITEM&nbsp;1A.<b>RISK</b>FACTORS</p><p>bad <i>things</i></p>": "ITEM\u00a01A.\nRISK\nFACTORS\nbad\nthings",
    "a<table><tr><td>x<table><tr><td>y</td></tr></table>z</td></tr></table>b": "a\nb",
    "a<table><tr><td>never closed<p>b": "a",
    "</table>a</p></div>b<p>c<div>d": "a\nb\nc\nd",
    "<script>if (a < b) { x = '<p>no</p>'; }</script>  <style>p {}</style>\n yes <!-- no --> &amp; so": "yes\n& so",
    "": "", "   ": "",
}


def test_filing_html_to_text(spark):
    assert {h: filing_text(h) for h in HTML} == {**HTML, "<script>if (a < b) { x = '<p>no</p>'; }</script>  <style>p {}</style>\n yes <!-- no --> &amp; so": "yes  & so"}
    rows = spark.createDataFrame([(k, h) for k, h in enumerate([*HTML, None])], "k long, html string")
    got = {r.k: r.text for r in filing_texts(rows).collect()}
    assert got == {**{k: filing_text(h) for k, h in enumerate(HTML)}, len(HTML): None}


def test_filing_from_html_to_chunks(spark):
    from tidelex import catalog

    html = f"<html><style>x</style><body><p>ITEM&nbsp;1A.&nbsp;RISK&nbsp;FACTORS</p><p>{sentence(60)}</p><table><tr><td>ITEM 1B.</td></tr></table><p>{sentence(50, 'b')}</p><p>ITEM&nbsp;1B. rest</p>"
    text = filing_texts(spark.createDataFrame([(5, 2020, html)], "filing_id long, year int, html string"))
    sections = text.select("filing_id", "year", F.explode(filing_sections(F.col("text"))).alias("s")).select("filing_id", "year", "s.section", "s.text")
    assert [(r.section, r.text, r.word_count) for r in chunk_filings(sections).collect()] == [("Risk Factors", f"{sentence(60)} {sentence(50, 'b')}", 110)]
    assert "filing_page_chunks" in catalog.QUERIES


def test_page_filings_are_chunked_to_their_end(spark, tmp_path):
    """Sections far over 12,000 characters keep all their sentences."""
    from tidelex import catalog

    body = [sentence(50, f"s{k}x") for k in range(200)]
    pages = spark.createDataFrame([(1, "http://a.example/", f"<p>{' '.join(body)}</p>")], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    rows = catalog.QUERIES["filing_page_chunks"](spark, str(tmp_path)).orderBy("position").collect()
    assert len(" ".join(body)) > 50_000 and " ".join(r.text for r in rows) == " ".join(body)
    assert {r.section for r in rows} == {"Risk Factors"}


def test_rows_of_a_batch_are_taken_in_slices(spark, monkeypatch):
    """However many rows a batch has, few of them are Python objects at a time; slices keep rows, order and nulls."""
    from tidelex.functions import html

    assert html.ROWS_AT_ONCE <= 64
    rows = spark.range(150).select("id", F.when(F.col("id") % 7 != 3, F.concat(F.lit("<p>page "), F.col("id").cast("string"))).alias("html")).coalesce(1)
    assert {r.id: r.text for r in html.filing_texts(rows).collect()} == {k: None if k % 7 == 3 else html.filing_text(f"<p>page {k}") for k in range(150)}
    sections = spark.range(150).select(F.col("id").alias("filing_id"), F.lit(2020).alias("year"), F.lit("s").alias("section"), F.concat(F.repeat(F.lit("word "), 60), F.col("id").cast("string")).alias("text")).coalesce(1)
    assert sorted(r.filing_id for r in html.chunk_filings(sections).collect()) == list(range(150))
