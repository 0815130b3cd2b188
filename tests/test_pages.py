"""Pages by hand: chrome, link lists, packing, thin pages and application state."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidelex import catalog
from tidelex.functions import text
from tidelex.functions.html import app_strings, chunk_pages, coverage


def said(n: int, name: str = "word") -> str:
    return " ".join([name.capitalize(), *(f"{name}{k}" for k in range(n - 2)), "end."])


def columns(spark, made, values):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r.x for r in frame.select("k", made(F.col("t")).alias("x")).orderBy("k").collect()]


CHROME = {
    "Hello. Sign in to get recommendations. New customer? Start here. We build things.": "We build things.",
    "Your Amazon.com Today's Deals | Help Gift Cards We build.": "We build.",
    "FREE Two-Day Shipping for members. Sponsored by Acme. We build.": ". We build.",
    "Save on everything you need for college now. com We build.": "We build.",
    "Search for Jobs at Amazon › Careers Home | FAQ Locations We build.": "We build.",
    "sign in here, gift cards Work hard. Have fun. Make history.": "Work hard. Have fun. Make history.",
    "A plain opening of no menu. Work hard. Have fun. Make history.": "A plain opening of no menu. Work hard. Have fun. Make history.",
    "one two three four five six your account seven At Amazon, we build.": "At Amazon, we build.",
    "your account At Amazon, we build.": "At Amazon, we build.",
    "some help At Amazon, we build.": "At Amazon, we build.",
    "see gift cards now At Amazon, we build.": "see gift cards now At Amazon, we build.",
    "At Amazon, we build. Help us: At Amazon, we do.": "At Amazon, we build. Help us: At Amazon, we do.",
    "We build. Conditions of Use Privacy Notice 1996": "We build.",
    "We build. Your Recent History (What's this?) Amazon.com Home | Directory of All Stores": "We build.",
    "HELLO SIGN IN": "", "": "", "Nothing to strip here.": "Nothing to strip here.",
}


def test_chrome(spark):
    got = columns(spark, text.without_chrome, list(CHROME))
    assert {k: v for k, v, w in zip(CHROME, got, CHROME.values(), strict=True) if v != w} == {}


def test_long_menus(spark):
    assert columns(spark, text.without_chrome, ["FAQ › " * 30_000 + "We build."]) == ["We build."]


PROSE = {
    "We hire people who like to build things for other people.": True,
    "short words only": False,
    "https://a.example/x we hire people who like to build things here": False,
    "/we hire people who like to build things for other people": False,
    "we hire people who like to build things see photo.png": False,
    "{we hire people who like to build things for other people": False,
    "12 34 56 78 90 12 34 56 78 90 12 34 people": False,
    "a b c d e f g h i j k l m n o p q r s t": False,
}


def test_prose(spark):
    assert dict(zip(PROSE, columns(spark, text.is_prose, list(PROSE)), strict=True)) == PROSE


def pages(spark, *rows):
    return spark.createDataFrame([(k, "http://a.example/x", h, "20140304000000") for k, h in enumerate(rows)], "page_id long, url string, html string, timestamp string")


def chunks(spark, *rows):
    out = {}
    for r in chunk_pages(pages(spark, *rows)).orderBy("page_id", "position").collect():
        assert (r.source_url, r.timestamp, r.year) == ("http://a.example/x", "20140304000000", 2014)
        assert r.word_count == len(r.text.split()) and r.position == len(out.get(r.page_id, []))
        out.setdefault(r.page_id, []).append((r.heading, r.text, r.extraction_source))
    return out


def test_packing(spark):
    a, b, c, d = said(40, "a"), said(200, "b"), said(120, "c"), said(9, "d")
    html = f"""<nav><p>{said(30, "menu")}</p></nav><h1>One</h1><p>{a}</p><p>{b}</p><ul><li>{c}</li></ul><h2>Two <b>bold</b></h2>
        <p>{d}</p><h3>Three</h3><p>Paris London Rome Berlin Madrid Vienna</p><p>too short</p><div>no text tag</div><h4>Four</h4>
        <td><p>{said(100, "inner")}</p></td><p>Home | Jobs | About | {said(60, "tail")}</p>"""
    got = chunks(spark, html)[0]
    assert got == [("One", f"{a} {b}", "dom"), ("One", c, "dom"), ("Four", f"{said(100, 'inner')} {said(60, 'tail')}", "dom")]


def test_a_large_paragraph_is_not_cut(spark):
    big, small = said(400, "big"), said(45, "small")
    assert [t for _, t, _ in chunks(spark, f"<p>{small}</p><p>{big}</p><p>{big}</p>")[0]] == [f"{small} {big}", big]


STATE = {
    "props": {
        "title": "Top title",
        "intro": said(14, "intro"),
        "sections": [
            {"name": "x", "heading": "Head of part", "body": said(15, "part"), "deep": {"a": {"b": {"label": "Deep label", "c": said(16, "deep")}}}},
            [said(20, "inlist"), {"text": said(17, "nolabel")}],
            {"title": "Intro0 word", "twice": said(14, "intro"), "url": "https://a.example/" + "x " * 20},
        ],
        "title2": 5,
        "label": said(30, "after"),
    },
    "n": None, "ok": True,
}


def state_page(state: str) -> str:
    return f"<html><p>tiny page</p><script id=\"__NEXT_DATA__\" type='application/json'>{state}</script></html>"


def test_application_state(spark):
    got = chunks(spark, state_page(json.dumps(STATE)), state_page("{bad json"), state_page("[]"), f"<p>{said(90)}</p>" + state_page(json.dumps(STATE)), None, "", "<p>x")
    assert got[0] == [
        ("Top title", said(14, "intro"), "next_data"), ("Head of part", said(15, "part"), "next_data"), ("Deep label", said(16, "deep"), "next_data"), ("", said(17, "nolabel"), "next_data"),
        ("Top title", said(30, "after"), "next_data"),
    ]
    assert set(got) == {0, 3} and got[3] == [("", said(90), "dom")]


def test_hints_and_order():
    page = state_page('{"b": "two", "a": {"label": "ab", "name": "Name", "title": 7, "z": "x"}, "b": "three", "c": [["no"], [{"d": "four"}]]}')
    assert app_strings(page) == [("", "three"), ("Name", "ab"), ("Name", "Name"), ("Name", "x"), ("", "four")]
    assert app_strings(state_page("[" * 100_000)) == [] and app_strings("<p>none</p>") == []


def test_a_heading_that_the_text_holds(spark):
    text_ = "About us " + said(12)
    assert chunks(spark, state_page(json.dumps({"title": "About us", "t": text_})))[0] == [("", text_, "next_data")]


def test_coverage(spark):
    found = coverage(chunk_pages(pages(spark, f"<h1>A</h1><p>{said(120)}</p><h1>B</h1><p>{said(60)}</p>", f"<p>{said(90)}</p>", "<p>none</p>"))).collect()
    assert {r.page_id: (r.chunk_count, r.dom_words, r.thin) for r in found} == {0: (2, 180, False), 1: (1, 90, True)}


@pytest.mark.parametrize("name", ["page_chunks", "page_coverage"])
def test_queries_on_given_pages(spark, tmp_path, name):
    html = f"<h1>A</h1><p>{said(120)}</p><h2>B</h2><p>{said(60)}</p>"
    spark.createDataFrame([(3, "http://a.example/", html), (4, "http://b.example/", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "page_coverage":
        assert [(r.page_id, r.chunk_count, r.dom_words, r.thin) for r in rows] == [(3, 2, 180, False)]
    else:
        assert sorted((r.page_id, r.position, r.heading, r.year, r.text) for r in rows) == [(3, 0, "A", 2008, said(120)), (3, 1, "B", 2008, said(60))]
