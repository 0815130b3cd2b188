"""Sketches bound what two texts have apart, and leave next to no pair of unrelated texts to be counted."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from tidelex.operators import text_ratio
from tidelex.operators.text_ratio import close_pairs, runs


def test_sketches_bound_the_runs_apart():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["ab", "abc", "é ", "dd"]) for _ in range(rnd.choice([0, 1, 4, 60, 300]))) for _ in range(30)]
    tile = text_ratio.Tile(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            apart = len(np.setxor1d(runs(a), runs(b), assume_unique=True))
            whole = np.bitwise_count(tile.whole[i] ^ tile.whole[j]).sum()
            assert np.bitwise_count(tile.folded[:, i] ^ tile.folded[:, j]).sum() <= whole <= apart


def test_few_unrelated_pairs_are_counted(monkeypatch):
    """Texts of the same few syllables have most runs in a hundred others; one in a hundred pairs is counted at most."""
    rnd, counted, intersect1d = random.Random(6), [], np.intersect1d

    def counting(*args, **options):
        counted.append(1)
        return intersect1d(*args, **options)

    monkeypatch.setattr(text_ratio, "HOT_TEXTS", 3)  # as if each run were in more texts than that
    monkeypatch.setattr(text_ratio.np, "intersect1d", counting)
    syllables = ["the ", "er", "on ", "an", "re", "ou ", "ti", "in ", "ha", "st "]
    texts = ["".join(rnd.choice(syllables) for _ in range(400)) for _ in range(200)]
    texts += [texts[0][:-5], texts[1] + "x"]
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.arange(len(texts))
    found = set(close_pairs(texts, np.ones(len(texts), bool), rank, lambda i, j: np.ones(len(j), bool), 0.92))
    assert found == {(0, 200), (201, 1)}
    assert len(counted) <= len(texts) * (len(texts) - 1) / 2 / 100


def test_tile_memory():
    """A tile takes less than 4 bytes a character besides its texts, while it is made and after."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["the ", "er", "on ", "an"]) for _ in range(800)) for _ in range(200)]
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        tile = text_ratio.Tile(texts)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert len(tile.texts) == 200
    assert peak < 4 * sum(map(len, texts))


def test_long_unrelated_texts_are_not_matched(monkeypatch):
    """Long texts of one language share most runs of five, and rare letters enough to excuse the rest; few pairs are matched block by block."""
    rnd, matched, close = random.Random(9), [], text_ratio.close
    monkeypatch.setattr(text_ratio, "close", lambda early, late, *rest: (matched.append(1), close(early, late, *rest))[1])
    syllables = ["the ", "er", "on ", "an", "re", "ou ", "ti", "in ", "ha", "st "] * 4 + ["b ", "c", "d", "f ", "g", "k", "l ", "m", "p", "v"]
    texts = ["".join(rnd.choice(syllables) for _ in range(3000)) for _ in range(40)]
    texts.append(texts[0][:-40])
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.arange(len(texts))
    assert set(close_pairs(texts, np.ones(len(texts), bool), rank, lambda i, j: np.ones(len(j), bool), 0.92)) == {(0, 40)}
    assert len(matched) <= 40
