"""Awkward documents that every operator has to take."""

from __future__ import annotations

import pytest

CLASHING = ["id", "digest", "keep_id", "n", "score", "chunk", "shard", "keys", "train", "node", "component", "rate", "copies", "__copies", "__id", "__copy", "__own", "__key", "line", "kept", "toxicity"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def rows_of(*pairs):
    return [(i, t, "en", "web", len(t or ""), *["x"] * len(CLASHING)) for i, t in pairs]


@pytest.fixture(scope="session")
def frame(spark):
    def make(*pairs, partitions: int = 3):
        made = spark.createDataFrame(rows_of(*pairs), SCHEMA)
        return made.repartition(partitions) if pairs else made

    return make


LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))
PAIRS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Alpha beta gamma delta"), (6, "alpha BETA gamma delta"), (6, "alpha BETA gamma delta"),
    (7, "line a\nline b\nline c\nline d"), (8, "x\nline a\nline b\nline c"), (9, "naïve café — ünïcode 東京 🙂 text"), (9, "same id, other text"),
    (None, "Alpha beta gamma delta"), (None, None), (10, LONG), (11, LONG), (12, "tab\tand\x0bvt\x0cff\rcr\xa0nbsp em"), (13, "a\x00b zero"), (14, "one"),
]


@pytest.fixture(scope="session")
def awkward(frame):
    return frame(*PAIRS)


@pytest.fixture(scope="session")
def none(frame):
    return frame()
