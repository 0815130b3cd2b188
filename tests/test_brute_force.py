"""Operators that SQL can't express, against plain Python."""

from __future__ import annotations

import difflib
from collections import Counter, defaultdict

import pytest

from tidelex import catalog
from tidelex.operators.dedup import near_duplicates_removed
from tidelex.operators.stats import bradley_terry


def test_bradley_terry(spark):
    games = [(1, 2, 1)] * 6 + [(2, 1, 2)] * 2 + [(2, 3, 2)] * 5 + [(3, 2, 3)] * 3 + [(1, 3, 1)] * 4 + [(4, 1, 1)]
    won, strength = Counter(w for *_, w in games), dict.fromkeys((1, 2, 3, 4), 0.25)
    for _ in range(200):
        met = {i: sum(1 / (strength[a] + strength[b]) for a, b, _ in games if i in (a, b)) for i in strength}
        new = {i: won[i] / met[i] for i in strength}
        strength = {i: x / sum(new.values()) for i, x in new.items()}
    got = {r.player: r.strength for r in bradley_terry(spark.createDataFrame(games, "a int, b int, winner int")).collect()}
    assert got == pytest.approx(strength, abs=1e-9)
    assert bradley_terry(spark.createDataFrame([], "a int, b int, winner int")).count() == 0


def greedy_by_hand(rows, threshold):
    kept = []
    for t, i in sorted({t: i for i, t in sorted(rows, reverse=True)}.items(), key=lambda x: (-len(x[0]), x[1])):
        if all(difflib.SequenceMatcher(None, t, k).ratio() < threshold for k, _ in kept):
            kept.append((t, i))
    return {(i, t) for t, i in kept}


def test_greedy_near_duplicates(spark):
    base = ["we build great products for everyone everywhere", "our mission is to organise the information", "short one"]
    rows = [(g, f"{k:03d}", t[: len(t) - k % 4] + "x" * (k % 3)) for g in ("a", "b") for k, t in enumerate(base * 6)] + [("a", "900", None), ("c", "901", ""), ("c", "902", "")]
    frame = spark.createDataFrame(rows, "g string, at string, text string")
    got = defaultdict(set)
    for r in near_duplicates_removed(frame, ["g"], "text", "at").collect():
        got[r.g].add((r.at, r.text))
    assert got == {g: greedy_by_hand([(i, t) for h, i, t in rows if h == g and t is not None], 0.92) for g in "abc"}


def test_no_close_pair_is_left(spark, small):
    groups = defaultdict(list)
    for r in catalog.QUERIES["near_duplicates_removed_by_group"](spark, small).collect():
        groups[r.company, r.year].append(r.text)
    assert groups
    for texts in groups.values():
        texts.sort(key=lambda t: -len(t))
        assert all(difflib.SequenceMatcher(None, b, a).ratio() < 0.92 for k, a in enumerate(texts) for b in texts[k + 1 :])


def test_near_duplicates_of_whole_chunks(spark, tmp_path):
    """Texts that differ in their openings only, texts that share nothing but the opening, and one of few words."""
    same, opening = " ".join(f"word{k} goes here" for k in range(40)), "We all start with the very same long sentence here. "
    docs = [(0, "Quite another opening of six words. " + same), (20, "Opening. " + same), (40, opening + "alpha beta " * 30), (60, opening + "1234 5678 " * 30), (80, "two words"), (100, None)]
    docs += [(120 + 20 * k, " ".join(f"v{x}" for x in range(k, 60 + k))) for k in range(6)]  # chains whose ends are not close
    frame = spark.createDataFrame([(i, t, "en", "acme") for i, t in docs], "doc_id long, text string, lang string, source string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.text) for r in catalog.QUERIES["near_duplicates_removed_by_group"](spark, str(tmp_path)).collect()}
    want = greedy_by_hand([(f"{i:05d}", t) for i, t in docs if t is not None], 0.92)
    assert got == {(int(i), t) for i, t in want} and {0, 40, 60, 80} <= {i for i, _ in got} and 20 not in {i for i, _ in got}


def test_whole_chunks_of_the_fixture(spark, small):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        groups[r.source, 2005 + r.doc_id % 20].append((r.doc_id, r.text))
    want = {i for g in groups.values() for i, _ in greedy_by_hand([(i, t) for i, t in g if t is not None], 0.92)}
    assert {r.doc_id for r in catalog.QUERIES["near_duplicates_removed_by_group"](spark, small).collect()} == want
