"""Reports with near-duplicate removal against a plain second implementation, and what stories are made of."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelex import catalog
from tidelex.functions import classify
from tidelex.operators import curate
from tidelex.operators.stats import p_value
from tidelex.plans.bindings import _TOLD, CHUNK_LABELS, digest_vectors
from tidelex.plans.model_queries import NEAR
from tidelex.sources import write_documents


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def vector(text):
    return unit(np.array(digest_vectors([text])[0], np.float32).astype(float))


def greedy(rows):
    """Of (text, chunk_id) rows those that no longer kept text is nearly alike."""
    once, kept = {}, []
    for text, key in sorted(rows, key=lambda r: r[1]):
        once.setdefault(text, key)
    for text, key in sorted(once.items(), key=lambda r: (-len(r[0]), r[1])):
        if all(difflib.SequenceMatcher(None, text, k).ratio() < 0.92 for k, _ in kept):
            kept.append((text, key))
    return {key for _, key in kept}


def split(text):
    clean = " ".join(text.split())
    parts = [p.strip() for p in re.split(r"(?<=[.!?…])\s+(?=[A-Z\"'(])", clean)]
    kept = [p for p in parts if len(p.split()) >= 6]
    return kept or ([clean] if len(clean.split()) >= 6 else [])


def axes(spark, folder):
    poles = defaultdict(lambda: defaultdict(list))
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        poles[("altruism", "altruism", "control", "inclusion", "meritocracy")[r.item_id % 5]]["b" if r.item_id % 5 == 1 else "a"].append(vector(r.text))
    return {a: unit(np.mean(p["a"], axis=0) - (np.mean(p["b"], axis=0) if p["b"] else 0)) for a, p in poles.items()}


def test_axis_report_with_near_duplicates(spark, small):
    docs = [r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text is not None]
    label = lambda t: (x if (x := _TOLD[len(t) % 8]) in CHUNK_LABELS else "navigation_junk")
    by = defaultdict(list)
    for r in docs:
        if label(r.text) == "mission_brand":
            by[r.source].append((r.text, hashlib.sha256(f"{r.doc_id}|{r.text}".encode()).hexdigest()[:16], 2005 + r.doc_id // 20 % 10))
    want, built = {}, axes(spark, small)
    for company, rows in by.items():
        keep = greedy([x[:2] for x in rows])
        rows = [x for x in rows if x[1] in keep]
        chunks, said = defaultdict(list), defaultdict(dict)
        for text, key, year in sorted(rows, key=lambda x: x[1]):
            chunks[year].append(vector(text))
            for i, s in enumerate(split(text)):
                said[year].setdefault(s, hashlib.sha256(f"{key}|{i}|{s}".encode()).hexdigest()[:16])
        years = sorted(chunks)
        carried = {y: None if b is None else np.mean([max(v @ w for w in chunks[b]) >= NEAR for v in chunks[y]]) for b, y in zip([None, *years], years, strict=False)}
        for axis in ("altruism", "control"):
            for level, vectors in (("chunk", chunks), ("sentence", {y: [vector(s) for s in x] for y, x in said.items()})):
                top = {y: np.mean(sorted((v @ built[axis] for v in x), reverse=True)[:5]) for y, x in vectors.items() if x}
                mean, sd = np.mean(list(top.values())), np.std(list(top.values()))
                for y, m in top.items():
                    want[axis, level, company, y] = (m, min(5, len(vectors[y])), len(vectors[y]), (m - mean) / sd if sd > 1e-15 else 0.0, carried[y] if level == "chunk" else None)
    got = {(r.axis, r.level, r.company, r.year): tuple(r)[4:] for r in catalog.QUERIES["axis_report_near_series"](spark, small).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-6), k


def test_stance_report_with_near_duplicates(spark, small):
    """Whole where nothing is near: the counts of the exact and of the near report differ by what near removal drops."""
    near = {(r.company, r.year): r for r in catalog.QUERIES["stance_report_near_series"](spark, small).collect()}
    exact = {(r.company, r.year): r for r in catalog.QUERIES["stance_report_series"](spark, small).collect()}
    assert set(near) == set(exact) and all(near[k].n_chunks <= exact[k].n_chunks and near[k].n_chunks_raw == exact[k].n_chunks_raw for k in near)
    same = [k for k in near if near[k].n_chunks == exact[k].n_chunks]
    assert same and all(near[k].inclusion_topk_mean == exact[k].inclusion_topk_mean and near[k].stance_max == exact[k].stance_max for k in same)


def test_p_of_the_validation(spark, small):
    r = {x.company: x for x in catalog.QUERIES["stance_validation"](spark, small).collect()}
    for x in catalog.QUERIES["stance_validation_p"](spark, small).collect():
        for c in ("meritocracy", "control"):
            p, rho = x[f"inclusion_{c}_p"], r[x.company][f"inclusion_{c}_spearman"]
            if p is None:
                assert rho is None or x.n < 3
            else:
                lo, hi = sorted((p_value(max(-1.0, rho - 6e-4), x.n), p_value(min(1.0, rho + 6e-4), x.n)))
                assert lo - 2e-3 <= p <= hi + 2e-3


def test_high_scoring(spark):
    rows = spark.createDataFrame([("a", 1, "x", 0.5), ("a", 1, "x", 0.7), ("a", 2, "x", 0.3), ("a", 1, "y", 0.29), ("b", 1, "x", None)], "company string, year int, text string, score double")
    got = {(r.company, r.year, r.text, r.score) for r in curate.high_scoring(rows, ["company", "year"], "text", "score").collect()}
    assert got == {("a", 1, "x", 0.7), ("a", 2, "x", 0.3)}
    assert curate.high_scoring(rows, ["company"], "text", "score").first().sentence_id == hashlib.sha256(b"x").hexdigest()[:12]


@pytest.mark.parametrize(("stance", "text", "bonus"), [("mission_intensity", "the future of the west", 0.08), ("mission_intensity", "hardest problems, smartest people", 0.05), ("mission_intensity", "mission-critical", 0.0), ("move_fast", "future of the west", 0.0)])
def test_bonus(spark, stance, text, bonus):
    row = spark.createDataFrame([(stance, text, 0.5)], "stance string, text string, score double").select(classify.with_bonus(F.col("score"), F.col("stance"), F.col("text")).alias("s")).first()
    assert row.s == pytest.approx(0.5 + bonus)


def test_stances_by_source(spark):
    rows = spark.createDataFrame([(1, "careers", "Work hard and have fun. We raise the bar."), (2, "investor", "Work hard and have fun. We raise the bar."), (3, "investor", "We are high-performing."), (4, "careers", "We are high-performing."), (5, "careers", None)], "id int, source string, text string")
    assert sorted((r.id, r.stance) for r in classify.stance_hits(rows, classify.PERFORMANCE_STANCES).collect()) == [(1, "raise_the_bar"), (1, "work_hard_play_hard"), (2, "raise_the_bar"), (3, "investor_tone")]


def test_story(spark, tmp_path):
    quotes = spark.createDataFrame([("b", 2, "q3"), ("a", 1, "q1 é"), ("b", 1, "q2")], "stance string, pick int, text string")
    terms = spark.createDataFrame([("later", "t2", 2012), ("later", "t1", 2010), ("early", "t0", 2009)], "lexicon string, term string, first_year int")
    row = curate.story(quotes, terms).first()
    assert [(q.stance, q.pick, q.text) for q in row.highlights] == [("a", 1, "q1 é"), ("b", 1, "q2"), ("b", 2, "q3")]
    assert {k: [t.term for t in v] for k, v in row.lexicons.items()} == {"later": ["t1", "t2"], "early": ["t0"]}
    write_documents(curate.story(quotes, terms).withColumn("story", F.lit("performance")), str(tmp_path / "out"), ["story"])
    (path,) = (tmp_path / "out" / "story=performance").glob("part-*")
    assert "q1 é" in path.read_text() and '"lexicons"' in path.read_text()
