"""The bounds of the near-duplicate join lose no pair, and neither do its tiles."""

from __future__ import annotations

import difflib
import random

import numpy as np
import pytest

from tidelex.operators import dedup, text_ratio
from tidelex.operators.text_ratio import Tile, close_pairs, common_subsequence, runs

LETTERS = "etaoin shrdlu" * 6 + "bcfgjkmpqvwxyz.,ETA"


def changed(rnd, text):
    t = list(text)
    for _ in range(rnd.randint(0, max(1, len(t) // 8))):
        kind = rnd.random()
        if kind < 0.33 and t:
            del t[rnd.randrange(len(t))]
        elif kind < 0.66:
            t.insert(rnd.randint(0, len(t)), rnd.choice(LETTERS))
        elif t:  # a stretch moves
            a = rnd.randrange(len(t))
            part = t[a : a + rnd.randint(1, 20)]
            del t[a : a + len(part)]
            at = rnd.randint(0, len(t))
            t[at:at] = part
    return "".join(t)


def family(rnd):
    bases = ["".join(rnd.choice(LETTERS) for _ in range(rnd.choice([0, 3, 8, 30, 150, 199, 200, 230, 600]))) for _ in range(3)]
    return sorted({x for b in bases for x in (b, changed(rnd, b), changed(rnd, b), changed(rnd, changed(rnd, b)))})


@pytest.mark.parametrize("hot", [0, 3, 64])
@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.92, 0.97])
def test_close_pairs_like_difflib(monkeypatch, threshold, hot):
    monkeypatch.setattr(text_ratio, "HOT_TEXTS", hot)
    rnd, hits = random.Random(int(100 * threshold)), 0
    for _ in range(30):
        texts = family(rnd)
        order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
        rank = np.empty(len(texts), np.int64)
        rank[order] = np.arange(len(texts))
        found = set(close_pairs(texts, np.ones(len(texts), bool), rank, lambda i, j: np.ones(len(j), bool), threshold))
        want = {(i, j) for k, i in enumerate(order) for j in order[k + 1 :] if difflib.SequenceMatcher(None, texts[j], texts[i]).ratio() >= threshold}
        assert found == want
        hits += len(want)
    assert hits > 10


def test_common_subsequence():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 30))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b):
                left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
        assert common_subsequence(a, b) == row[-1]


def test_overlaps_count_repeats():
    texts = ["abcdeabcdeabcde", "abcdeabcde", "", "xyz", "abcdé"]
    tile = Tile(texts)
    for i, a in enumerate(texts):
        grams = lambda t: [t[k : k + 5] for k in range(len(t) - 4)]
        for j, b in enumerate(texts):
            want = sum(min(grams(a).count(g), grams(b).count(g)) for g in set(grams(a)))
            assert tile.overlaps(i)[j] == (want if i != j else tile.overlaps(i)[i])
    assert len(runs("abcd")) == 0


@pytest.mark.parametrize("pairs", [0, 1 << 21])
def test_matcher_decides_like_difflib(monkeypatch, pairs):
    """At thresholds on, above and below the ratio of a pair, whatever the lengths, and where its equal characters are too many to hold."""
    monkeypatch.setattr(text_ratio, "PAIRS", pairs)
    rnd = random.Random(11)
    for _ in range(60):
        texts = ["", "aa", "abab" * 60, *family(rnd)]
        for early, late in [(rnd.choice(texts), rnd.choice(texts)) for _ in range(8)]:
            ratio = difflib.SequenceMatcher(None, late, early).ratio()
            matcher = text_ratio.Matcher(early)
            for threshold in {ratio, min(1.0, ratio + 1e-4), max(1e-4, ratio - 1e-4), 0.5, 0.92}:
                assert matcher.reaches(late, threshold) == (ratio >= threshold)


def greedy(rows, threshold=0.92):
    kept = []
    once = {}
    for at, text in sorted(rows):
        once.setdefault(text, at)
    for text, at in sorted(once.items(), key=lambda x: (-len(x[0]), x[1])):
        if all(difflib.SequenceMatcher(None, text, k).ratio() < threshold for k, _ in kept):
            kept.append((text, at))
    return {at for _, at in kept}


def test_large_groups_in_blocks(spark, monkeypatch):
    """A scope that holds most rows is dealt to blocks; the greedy choice is that of one list."""
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 7)
    rnd = random.Random(3)
    rows = [(scope, f"{k:04d}", t, "x") for scope, n in (("a", 9), ("b", 1), ("c", 2)) for k, t in enumerate(x for _ in range(n) for x in family(rnd))]
    rows += [("b", "9999", None, "y")]
    frame = spark.createDataFrame(rows, "scope string, at string, body string, block string")
    got = {(r.scope, r.at) for r in dedup.near_duplicates_removed(frame, ["scope"], "body", "at").collect()}
    assert got == {(s, at) for s in "abc" for at in greedy([(a, t) for x, a, t, _ in rows if x == s and t is not None])}


@pytest.mark.parametrize("rows", [15, 25, 60])
def test_each_pair_meets_once(spark, monkeypatch, rows):
    """However many blocks a group is dealt to, every close pair is found in one tile."""
    from pyspark.sql import functions as F

    rnd = random.Random(13)
    base = "".join(rnd.choice(LETTERS) for _ in range(150))
    texts = sorted({"".join(x for x in base if rnd.random() > 0.06) for _ in range(50)}, key=lambda t: (-len(t), t))
    frame = spark.createDataFrame([(k, "s", f"{k:03d}", t) for k, t in enumerate(texts)], "__row long, __scope string, at string, body string")
    monkeypatch.setattr(dedup, "BLOCK_ROWS", rows)
    got = sorted((r.early, r.late) for r in dedup._close_pairs(frame.repartition(4, F.col("at")), "body", "at", 0.92).collect())
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if difflib.SequenceMatcher(None, texts[j], texts[i]).ratio() >= 0.92]
    assert got == want and len(want) > 20
