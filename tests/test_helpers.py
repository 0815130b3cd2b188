"""Small functions that no query stands for."""

from __future__ import annotations

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidelex.functions import classify, text
from tidelex.operators import captures, curate, dedup, rollup, stats


@pytest.mark.parametrize(("r", "n", "p"), [(0.0, 10, 1.0), (0.5, 3, 2 / 3), (-0.5, 3, 2 / 3), (0.6, 4, 0.4), (1.0, 5, 0.0), (0.5, 2, None), (float("nan"), 9, None)])
def test_p_value(r, n, p):
    """Three pairs give the Cauchy distribution, four an even one in r."""
    assert stats.p_value(r, n) == (p if p is None else pytest.approx(p, abs=1e-9))


def test_nav_runs_are_searched_wherever_they_can_be(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice(["a", "bc", " ", " - ", " | ", "»", "·", " – ", "-", "  "]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    plain = re.compile(r"(?:[^\s][^|»·]{0,45}?\s*(?:\s[-–—|·]\s|»)\s*){3,}")
    made += ["".join(rng.choice(["abcdefghij", "k" * 22, " ", " - ", " | ", "»", " – "]) for _ in range(rng.randint(6, 30))) for _ in range(2000)] + ["nav | " * 20_000 + "prose"]
    want = [" ".join(plain.sub(" ", m).split()) for m in made]
    rows = spark.createDataFrame(list(zip(made, want, strict=True)), "t string, want string")
    assert rows.where(text.strip_nav_runs(F.col("t")) != F.col("want")).limit(3).collect() == []


def test_columns(spark):
    rows = spark.createDataFrame([("https://jobs.acme.com/x", "Home | Jobs | About | we build things here"), ("https://notacme.com/", "plain")], "url string, text string")
    got = rows.select(text.on_hosts(F.col("url"), F.array(F.lit("acme.com"))).alias("on"), text.strip_nav_runs(F.col("text")).alias("t"), classify.coerce(F.col("text"), ["plain"], "other").alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, "we build things here", "other"), (False, "plain", "plain")]


def test_sentences_keep_digits_at_their_ends(spark):
    """A sentence whose place is a digit that it begins or ends with."""
    rows = spark.createDataFrame([("0997 begins what this text says here. And so it goes on until 11",), ("0 only five words here",), (None,)], "t string")
    got = [r.s for r in rows.select(text.sentences(F.col("t")).alias("s")).collect()]
    assert got[:2] == [["0997 begins what this text says here.", "And so it goes on until 11"], []] and not got[2]


def test_similarity(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("x", None)]
    got = spark.createDataFrame(pairs, "a string, b string").select(dedup.similarity("a", "b").alias("s")).collect()
    assert [r.s for r in got] == [None if b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_records_prefixes_and_means(spark):
    answers = spark.createDataFrame([([["urlkey", "timestamp"], ["a", "1"], ["b", "2"]],), ([],), ([["urlkey"]],)], "rows array<array<string>>")
    assert sorted((r.record["urlkey"], r.record["timestamp"]) for r in captures.header_rows(answers).collect()) == [("a", "1"), ("b", "2")]
    quotes = spark.createDataFrame([(1, "same start, one"), (2, "same start, two"), (3, "else")], "id int, text string")
    assert sorted(r.id for r in curate.distinct_prefix(quotes, "text", 10, [F.desc("id")]).collect()) == [2, 3]
    series = spark.createDataFrame([("a", 2010, 1.0), ("b", 2010, 3.0), ("b", 2011, None)], "company string, year int, v double")
    assert {r.year: (r.industry_mean, r.n_groups) for r in rollup.group_mean(series, "year", "v").collect()} == {2010: (2.0, 2), 2011: (None, 0)}


def test_temporary_tables_are_deleted(spark):
    from tidelex.sources import path_exists
    from tidelex.storage import kept, scratch, temporary

    outside = kept(spark.range(3), "outside").inputFiles()[0].rpartition("/")[0]
    with temporary(spark):
        rows = kept(spark.range(5), "inside")
        inside, empty = rows.inputFiles()[0].rpartition("/")[0], scratch(spark, "never-written")
        with temporary(spark):
            nested = kept(spark.range(2), "nested").inputFiles()[0].rpartition("/")[0]
        assert rows.count() == 5 and path_exists(spark, inside) and not path_exists(spark, nested)
    assert path_exists(spark, outside) and not path_exists(spark, inside) and not path_exists(spark, empty)


@pytest.mark.parametrize("most", [0, 200_000])
def test_shared_ngrams_either_way(spark, monkeypatch, most):
    from tidelex.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_GRAMS", most)
    rows = spark.createDataFrame([(1, ["a b", "b c"]), (2, ["x y"]), (3, None), (4, ["b c", "b c"])], "k int, g array<string>")
    other = spark.createDataFrame([(["b c", "q"],), (None,)], "h array<string>")
    assert sorted(r.k for r in joins.shares_ngram(rows, "k", "g", other, "h").collect()) == [1, 4]
