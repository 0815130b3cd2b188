"""The pipeline's near copies with changed words, against brute force over all pairs."""

from __future__ import annotations

from itertools import combinations

import corpus_pipeline
import numpy as np

from tidelex.llm import shingle_copies
from tidelex.llm.common import table


def by_hand(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def close_pairs(docs):
    sets = {i: s for i, t in docs.items() if (s := by_hand(t or ""))}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}


def after_deduplication(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        if "dedup" in name:
            docs = stage(spark, docs, sf_dir)
    return {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_leaves_no_near_copy(spark, middle):
    docs = table(spark, middle, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(t or "", i)
    pairs = close_pairs({i: t for t, i in first.items()})
    kept = after_deduplication(spark, docs, middle)
    assert pairs and not [p for p in pairs if set(p) <= kept]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "sentencepiece"]


def test_recall_against_brute_force(spark, frame):
    """Texts with one to nine changed words, and a group too large for all its pairs in the first round."""
    rng = np.random.default_rng(8)
    pairs = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        pairs.append((10 * k, " ".join(words)))
        for c in range(1, 5):
            other = list(words)
            for at in rng.integers(0, 150, rng.integers(1, 10)):
                other[at] = "new"
            pairs.append((10 * k + c, " ".join(other)))
    big = [f"g{x}" for x in range(200)]
    pairs += [(10_000 + k, " ".join(big[:k] + ["x"] + big[k:])) for k in range(0, 200, 2)] + [(20_000, ""), (20_001, ""), (20_002, "short one"), (None, " ".join(big))]
    close = close_pairs({i: t for i, t in pairs if i is not None})
    up = {i: i for i, _ in pairs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in close:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r.node: r.component for r in shingle_copies.copy_components(frame(*pairs)).collect()}
    assert len(close) > 1000 and got == {i: top(i) for i in {x for p in close for x in p}}


def test_large_bands_in_tiles(frame, monkeypatch):
    """Bands of more texts than a block holds give the links that one block gives."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in range(120)]
    pairs = []
    for k in range(90):
        words = list(base)
        for at in rng.integers(0, 120, 1 + k % 9):
            words[at] = f"new{k}"
        pairs.append((k, " ".join(words)))
    got = {r.node: r.component for r in shingle_copies.copy_components(frame(*pairs)).collect()}
    monkeypatch.setattr(shingle_copies, "TILE_ROWS", 8)
    assert got and {r.node: r.component for r in shingle_copies.copy_components(frame(*pairs)).collect()} == got


def test_awkward(awkward, none):
    kept = shingle_copies.drop_near_copies(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id in (2, 3, 11, 14)").count() == 0 and kept.where("doc_id is null").count() == 2
    assert shingle_copies.drop_near_copies(none).count() == 0
