"""What the driver holds of a labelled sample when a fit begins."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from tidelex.llm import toxicity


def test_toxicity_sample_is_packed(spark, monkeypatch):
    """About 8 bytes an entry of the sample's rows; as a Counter a row it was some 100."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(600)]
    rows = [(" ".join(rnd.sample(words, 150)), k % 2) for k in range(400)]
    held = []

    def fit_weights(rows, labels, changes, size, *rest):
        held.append((tracemalloc.get_traced_memory()[0] - before, len(rows), len(labels)))
        return np.zeros(size), 0.0

    monkeypatch.setattr(toxicity, "fit_weights", fit_weights)
    frame = spark.createDataFrame(rows, "text string, toxic int")
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        toxicity.fit(frame)
    finally:
        tracemalloc.stop()
    assert held[0][1:] == (400, 400)
    assert held[0][0] < 400 * 150 * 5 * 20  # a word of six letters has five features
