"""Interval, nearest and cosine joins against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelex.operators import cosine, rollup
from tidelex.operators.joins import nearest, within


def test_within_spans_of_all_lengths(spark):
    rnd = random.Random(1)
    spans = []
    for k in range(300):
        first = rnd.randint(-(10**6), 10**6)
        spans.append((k, first, first + rnd.choice([0, 1, 2, 3, 7, 100, 4095, 4096, 10**6])))
    spans += [(900, 5, 4), (901, None, 7), (902, 3, None)]
    points = [(k, rnd.randint(-(10**6), 2 * 10**6)) for k in range(400)] + [(k + 1000, x) for k, (_, a, b) in enumerate(spans[:100]) for x in (a, b, a - 1, b + 1)] + [(9999, None)]
    got = within(spark.createDataFrame(points, "p int, x int"), "x", spark.createDataFrame(spans, "s int, lo int, hi int"), "lo", "hi")
    assert set(got.columns) == {"p", "x", "s", "lo", "hi"}
    want = sorted((p, s) for p, x in points if x is not None for s, a, b in spans if a is not None and b is not None and a <= x <= b)
    assert sorted((r.p, r.s) for r in got.collect()) == want and len(want) > 1000
    assert within(spark.createDataFrame(points, "p int, x int"), "x", spark.createDataFrame([], "s int, lo int, hi int"), "lo", "hi").count() == 0


def test_spans_do_not_multiply_with_their_length(spark):
    spans = spark.range(1000).select(F.col("id").alias("s"), F.col("id").alias("lo"), (F.col("id") + 10**6).alias("hi"))
    points = spark.range(100).select((F.col("id") * 20_000).alias("x"))
    plan = within(points, "x", spans, "lo", "hi")
    assert plan.count() == sum(lo <= 20_000 * p <= lo + 10**6 for p in range(100) for lo in range(1000))


def test_nearest(spark):
    rnd = random.Random(2)
    left = [(rnd.randrange(5), rnd.randint(0, 60), k) for k in range(120)] + [(1, None, 500), (None, 3, 501), (77, 3, 502)]
    right = [(rnd.randrange(5), rnd.randint(0, 60), f"r{rnd.randrange(40)}") for _ in range(60)] + [(1, None, "none"), (None, 3, "nokey")]
    a = spark.createDataFrame(left, "k int, x int, id int")
    b = spark.createDataFrame(right, "k int, y int, name string")
    got = {r.id: (r.nearest.y, r.nearest.name) for r in nearest(a, b, ["k"], F.col("x"), F.col("y"), ["y", "name"], ["name", "y"]).collect()}
    want = {}
    for k, x, i in left:
        found = [(abs(x - y), n, y) for kk, y, n in right if k is not None and x is not None and kk == k and y is not None]
        if found:
            want[i] = (min(found)[2], min(found)[1])
    assert got == want


def vectors(seed, n, keys=3):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(keys)), k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(n)]
    return [*rows, (0, 10_000, None), (0, 10_001, [1.0, None, 0.0, 0.0]), (0, 10_002, [0.0] * 4), (0, 10_003, [1.0, 2.0]), (None, 10_004, [1.0] * 4)]


def along(a, b):
    if a is None or b is None or None in a or None in b or len(a) != len(b) or not any(a) or not any(b):
        return None
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("block", [7, 8192])
def test_close_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cosine, "BLOCK_ROWS", block)
    rows = vectors(1, 90)
    frame = spark.createDataFrame(rows, "k int, id int, v array<double>")
    got = {(r.a, r.b): round(r.cosine, 9) for r in cosine.close_pairs(frame, frame, ["k"], "id", "v", 0.75, ordered=True).collect()}
    want = {(i, j): round(c, 9) for k, i, v in rows for q, j, w in rows if i < j and k is not None and k == q and (c := along(v, w)) is not None and c >= 0.75}
    assert got == pytest.approx(want) and len(want) > 20


def test_carried_forward_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cosine, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(4)
    rows = [(f"c{rng.integers(2)}", int(rng.choice([2001, 2002, 2005])), k, [float(x) for x in rng.integers(-2, 3, 3)]) for k in range(80)]
    frame = spark.createDataFrame(rows, "company string, year int, id int, v array<double>")
    got = {(r.company, r.year): r.carried_forward_frac for r in rollup.carried_forward(frame, ["company"], "year", "id", "v", 0.9).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        years = sorted({r[1] for r in rows if r[0] == c})
        for before, year in zip([None, *years], years, strict=False):
            now, old = ([r[3] for r in rows if r[0] == c and r[1] == y] for y in (year, before))
            want[c, year] = None if before is None else sum(any((x := along(v, w)) is not None and x >= 0.9 - 1e-12 for w in old) for v in now) / len(now)
    assert got == pytest.approx(want)
