"""Toxicity, Katz backoff and mixing: brute force, probabilities that add up, and held-out accuracy."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelex.llm import queries
from tidelex.llm.common import table
from tidelex.llm.katz import katz_scores
from tidelex.llm.mixing import SLOTS as MIX_SLOTS
from tidelex.llm.mixing import labelled_sample, mix_documents, mixing_rates, replay
from tidelex.llm.toxicity import IDENTITY_TERMS, SLOTS, ToxicityModel, features, fit, score, swapped, training_sample, words_of

from ..conftest import DATA
from .conftest import PAIRS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIDDLE_LARGE = f"{DATA}/sf0.1"


# toxicity


def auc(scores, labels):
    s, y = np.asarray(scores), np.asarray(labels)
    order = s.argsort()
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_toxicity_held_out(spark):
    found = queries.op5_toxicity(spark, MIDDLE_LARGE)
    labels = table(spark, MIDDLE_LARGE, "labels").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert auc([r.score for r in held], [r.toxic for r in held]) > 0.95
    hits = sum(r.toxic and r.predicted for r in held)
    assert hits >= 0.85 * sum(r.toxic for r in held) and hits >= 0.85 * sum(r.predicted for r in held)


def counts_by_hand(text, at):
    out = Counter()
    for w in words_of(text):
        out.update(at[f] for f in features(w) if f in at)
    return out


def test_toxicity_query_by_brute_force(spark, small):
    """The whole query: sample, screening and objective made plainly, its minimum found by small plain steps, all documents scored."""
    texts = {r.doc_id: r.text or "" for r in table(spark, small, "documents").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, small, "labels").collect()}
    taught = [i for i in texts if i in labels and zlib.crc32(str(i).encode()) % 5]
    y = np.array([labels[i] for i in taught], float)
    held = [{f for w in words_of(texts[i]) for f in features(w)} for i in taught]
    n, n1 = len(y), y.sum()
    both, toxic = Counter(f for h in held for f in h), Counter(f for h, t in zip(held, y, strict=True) if t for f in h)
    share = n1 / n
    apart = {f: abs(toxic[f] - c * share) / math.sqrt(c * share * (1 - share) * max(1 - c / n, 1e-9) + 0.5) for f, c in both.items() if c > 1}
    at = {f: k for k, f in enumerate(sorted(sorted(apart, key=lambda f: (-apart[f], f))[:4096]))}

    def dense(rows):
        m = np.zeros((len(rows), len(at)))
        for k, c in enumerate(rows):
            m[k, list(c)] = list(c.values())
        return m

    x = dense([counts_by_hand(texts[i], at) for i in taught])
    moved = [x_new - x_old for i, x_old in zip(taught, x, strict=True) for s in swapped(words_of(texts[i]), IDENTITY_TERMS) for x_new in dense([counts_by_hand(" ".join(s), at)])]
    moved = np.array([m for m in moved if m.any()]).reshape(-1, len(at))

    def loss(w, b):
        z = x @ w + b
        swaps = 4.0 / 2 * np.mean((moved @ w) ** 2) if len(moved) else 0.0
        return np.mean(np.logaddexp(0, z) - y * z) + swaps + 1e-5 / 2 * w @ w + 2e-4 * np.abs(w).sum()

    model = fit(training_sample(table(spark, small, "documents"), table(spark, small, "labels")))
    assert set(model.weights) <= set(at)
    own = np.zeros(len(at))
    for f, v in model.weights.items():
        own[at[f]] = v
    w, b = own.copy(), model.bias
    curved = 0.25 * (np.linalg.norm(x, 2) ** 2 + n) / n + (4.0 * np.linalg.norm(moved, 2) ** 2 / len(moved) if len(moved) else 0.0) + 1e-5
    for _ in range(1500):  # plain proximal steps go on from where the fit ended
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        grad = x.T @ g / n + 1e-5 * w + (4.0 * moved.T @ (moved @ w) / len(moved) if len(moved) else 0.0)
        w = w - grad / curved
        w = np.sign(w) * np.maximum(np.abs(w) - 2e-4 / curved, 0)
        b -= g.mean() / curved
    assert loss(own, model.bias) < loss(w, b) + 0.01 and loss(own, model.bias) < 0.5 * loss(np.zeros(len(at)), 0.0)
    for r in queries.op5_toxicity(spark, small).collect():
        z = model.bias + sum(own[k] * c for k, c in counts_by_hand(texts[r.doc_id], at).items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_samples_are_bounded_in_rows(spark, frame):
    docs = frame(*((7, f"t{i:03d}") for i in range(300)), (8, "x"))
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r.text for r in training_sample(docs, labels, held_out_fold=9).collect()) == ["t000", "t001", "t002", "t003", "x"]
    assert labelled_sample(docs, labels, "lang").count() == 5


def test_training_sample_leaves_the_fold_out(spark, frame):
    docs = frame(*((i, f"t{i}") for i in range(200)), (None, "x"), (3, "t3"))
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)] + [(4, 1, None), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    out = [r.text for r in training_sample(docs, labels).collect()]
    assert Counter(out) == Counter([f"t{i}" for i in [*range(200), 3] if zlib.crc32(str(i).encode()) % 5])
    assert len(training_sample(docs, labels, sample_rows=10).select("text").distinct().collect()) == 10


TOXIC = ["you are a stupid idiot", "stupid fool go away", "what an idiot you are", "stupid and ugly fool"]
NICE = ["have a lovely day", "the meeting is at noon", "thanks for the kind help", "we walked along the river"]


def labelled(spark, bias_term):
    """Toxic texts that name one group far more often than clean ones do."""
    rows = [(f"{t} {bias_term if k % 4 else ''} {k}", 1) for k in range(60) for t in TOXIC] + [(f"{t} {bias_term if k % 20 == 0 else ''} {k}", 0) for k in range(60) for t in NICE]
    return spark.createDataFrame(rows, "text string, toxic int").repartition(4)


def test_swaps_lower_the_bias_on_neutral_mentions(spark):
    rows = labelled(spark, "muslims")
    with_penalty, without = fit(rows, swap_penalty=20.0), fit(rows, swap_penalty=0.0)
    neutral = spark.createDataFrame([(1, "muslims have a lovely day"), (2, "christians have a lovely day"), (3, "stupid idiot"), (4, "")], "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in score(neutral, m).collect()} for m in (with_penalty, without))
    assert a[1] < b[1] and abs(a[1] - a[2]) < 0.5 * abs(b[1] - b[2])
    assert a[1] < 0.5 < a[3]


def test_toxicity_awkward(spark, awkward, none):
    model = fit(labelled(spark, "women"))
    got = score(awkward, model, keep="toxic score")
    assert got.columns == [*awkward.columns, "toxic score"]
    alone = ToxicityModel(model.weights, model.bias).scorer()
    assert sorted(((r.doc_id or 0), r.score) for r in score(awkward, model).collect()) == sorted((i or 0, alone(t or "")) for i, t in PAIRS)
    assert score(none, model).count() == 0
    nothing = fit(spark.createDataFrame([], "text string, toxic int"))
    assert [r.score for r in score(awkward.limit(1), nothing).collect()] == [0.5]
    one_sided = fit(spark.createDataFrame([("a", 1), (None, 1), ("b", None)], "text string, toxic int"))
    assert 0.5 < score(awkward.limit(1), one_sided).first().score < 1


def test_swapped_and_features():
    made = swapped(words_of("The Old gay women"), IDENTITY_TERMS)
    assert {"the", "young", "gay", "women"} in made and {"the", "old", "straight", "women"} in made and len(made) == 5 + 3 + 1
    assert all(0 <= f < SLOTS for f in features("ünïcode")) and len(features("ab")) == 1 and len(features("abcdefghij")) == 6


# Katz


def good_turing(counts, top=5):
    n = Counter(counts)
    for k in range(top, 0, -1):
        if all(n[r] > 0 for r in range(1, k + 2)):
            over = (k + 1) * n[k + 1] / n[1]
            if over < 1:
                d = {r: ((r + 1) * n[r + 1] / n[r] / r - over) / (1 - over) for r in range(1, k + 1)}
                if all(0 < x <= 1 for x in d.values()):
                    return lambda r: d.get(r, 1.0)
    return lambda r: 1 - 0.5 / r if 1 <= r <= top else 1.0


class KatzByHand:
    def __init__(self, docs, top=5):
        self.c = Counter(t for d in docs for t in d)
        self.total, self.kinds = sum(self.c.values()), len(self.c)
        self.after = defaultdict(Counter)
        for d in docs:
            for h, t in zip(["<start>", *d], d, strict=False):
                self.after[h][t] += 1
        self.d1, self.d2 = good_turing(self.c.values()), good_turing([x for a in self.after.values() for x in a.values()])
        left = sum((1 - self.d1(c)) * c for c in self.c.values())
        self.over, self.unseen = (self.total, left / self.total) if left > 0 else (self.total + 1, 1 / (self.total + 1))

    def p1(self, t):
        return self.d1(c) * c / self.over if (c := self.c[t]) else self.unseen

    def p(self, h, t):
        if h not in self.after:
            return self.p1(t)
        seen = self.after[h]
        whole, left = sum(seen.values()), sum((1 - self.d2(c)) * c for c in seen.values())
        if left <= 0:
            whole, left = whole + 1, 1.0
        if t in seen:
            return self.d2(seen[t]) * seen[t] / whole
        return left / whole / max(1 - sum(map(self.p1, seen)), self.unseen) * self.p1(t)

    def score(self, d):
        return sum(math.log10(self.p(h, t)) for h, t in zip(["<start>", *d], d, strict=False))

    def base(self, d):
        return sum(math.log10((self.c[t] + 1) / (self.total + self.kinds + 1)) for t in d)


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "<end>"]


def test_katz_whole_table(spark, small):
    docs = {r.doc_id: tokens(r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    model = KatzByHand([d for i, d in docs.items() if i not in held])
    got = queries.op6_katz(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        d = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(d), sum(model.c[t] > 0 for t in d), model.total)
        assert r.base_score == pytest.approx(model.base(d), rel=1e-9)
        assert r.score == pytest.approx(model.score(d), rel=1e-9)
    for h in ["<start>", *list(model.after)[:40]]:  # exactly normalised over the vocabulary and the unseen class
        assert sum(model.p(h, t) for t in [*model.c, "never seen"]) == pytest.approx(1, abs=1e-9)


def test_katz_awkward(frame, none):
    pairs = [(i, t and t[:6000]) for i, t in PAIRS]  # the model by hand is slow on longer texts
    got = katz_scores(frame(*pairs), F.lit(True)).collect()
    model = KatzByHand([tokens(t) for _, t in pairs])
    want = sorted((i or 0, len(tokens(t)), round(model.score(tokens(t)), 8), round(model.base(tokens(t)), 8)) for i, t in pairs)
    assert sorted((r.doc_id or 0, r.n_tokens, round(r.score, 8), round(r.base_score, 8)) for r in got) == want
    untaught = katz_scores(frame((1, "a b"), (2, None)), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in untaught} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert katz_scores(none, F.lit(True)).count() == 0


# mixing


def test_mixing_meets_the_targets(spark, middle):
    rows = queries.op9_mixing(spark, middle).collect()
    assert len(rows) == table(spark, middle, "documents").count()
    n, p, rate = (np.array([r[c] for r in rows], float) for c in ("n_tokens", "posterior", "rate"))
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    expected = (p * (rate * n)[:, None]).sum(axis=0)
    want = np.array([queries.TARGETS[d] for d in sorted(queries.TARGETS)])
    assert np.abs(expected / n.sum() - want).max() < 1e-3
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)
    lang = {r.doc_id: r.lang for r in table(spark, middle, "documents").select("doc_id", "lang").collect()}
    domains = sorted(queries.TARGETS)
    assert np.mean([domains[int(np.argmax(r.posterior))] == lang[r.doc_id] for r in rows if r.n_tokens > 20]) > 0.95


def test_mixing_is_the_projected_gradient(spark, frame):
    """The rates of replayed residuals are those of plain projected steps over all documents."""
    rng = np.random.default_rng(1)
    p, history = rng.dirichlet([1, 1, 1], 50), rng.normal(0, 1.5, (6, 3))
    rate, at_zero = np.ones(50), 0
    for step in history:
        rate = np.clip(rate - p @ step, 0, None)
        at_zero += (rate == 0).sum()
    assert np.allclose(replay(p, history), rate) and at_zero


def test_mixing_query_by_brute_force(spark, small):
    """The whole query: classifier, posteriors and plain projected gradient steps with all documents in one array."""
    docs = {r.doc_id: (r.text or "", r.lang) for r in table(spark, small, "documents").select("doc_id", "text", "lang").collect()}
    domains, ids = sorted(queries.TARGETS), sorted(docs)
    words = [docs[i][0].lower().split() for i in ids]
    x = np.zeros((len(ids), MIX_SLOTS))
    for k, ws in enumerate(words):
        for w in ws:
            x[k, zlib.crc32(w.encode()) % MIX_SLOTS] += 1 / len(ws)
    x = np.sqrt(x)
    marked = {r.doc_id for r in table(spark, small, "labels").select("doc_id").collect()}
    taught = [k for k, i in enumerate(ids) if i in marked and docs[i][1] in domains]
    y = np.array([[docs[ids[k]][1] == d for d in domains] for k in taught], float)
    w, b = np.zeros((MIX_SLOTS, len(domains))), np.zeros(len(domains))

    def soft(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(300):
        g = soft(x[taught] @ w + b) - y
        w -= 4.0 * (x[taught].T @ g / len(taught) + 1e-4 * w)
        b -= g.mean(axis=0)
    p, n = soft(x @ w + b), np.array([len(ws) for ws in words], float)
    want = np.array([queries.TARGETS[d] for d in domains]) / sum(queries.TARGETS.values()) * n.sum()
    rate, inverse = np.ones(len(ids)), np.linalg.pinv((p * n[:, None]).T @ p, rcond=1e-9)
    for _ in range(40):
        off = (rate * n) @ p - want
        if np.abs(off).max() <= 1e-4 * n.sum():
            break
        rate = np.clip(rate - p @ (inverse @ off), 0, None)
    got = {r.doc_id: r for r in queries.op9_mixing(spark, small).collect()}
    assert sorted(got) == ids and [got[i].n_tokens for i in ids] == n.tolist()
    assert np.allclose([got[i].posterior for i in ids], p, atol=1e-3)
    assert np.allclose([got[i].rate for i in ids], rate, atol=1e-2)
    assert {r.residual for r in got.values()} == {next(iter(got.values())).residual} and got[ids[0]].residual <= 1e-4


def test_mixing_tells_unmet_targets(spark, awkward):
    labels = spark.createDataFrame([(i, 1, 0) for i in (4, 5, 6, 7)], "doc_id long, quality int, toxic int")
    assert mixing_rates(awkward, labels, {"en": 0.1, "fr": 0.9}, max_rate=1.5).first().residual > 0.1


def test_mixing_awkward(spark, frame, awkward, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 4, 5, 6, 7)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    targets = {"en": 0.7, "fr": 0.3}
    rows = mixing_rates(awkward, labels, targets).collect()
    assert len(rows) == len(PAIRS) and all(r.rate >= 0 for r in rows)
    rows = mixing_rates(awkward, labels, targets, max_rate=3.0).collect()  # next to no French: without a bound it takes many copies
    assert max(r.rate for r in rows) <= 3
    mixed = mix_documents(awkward, labels, targets, max_rate=3.0)
    assert mixed.columns == awkward.columns
    copies = {i: min(r.copies for r in rows if r.doc_id == i) for i, _ in PAIRS}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: sum(1 for j, _ in PAIRS if j == i) * c for i, c in copies.items() if c})
    assert mixing_rates(none, labels, targets).count() == mix_documents(none, labels, targets).count() == 0
    assert mixing_rates(awkward, labels.limit(0), targets).count() == len(PAIRS)  # no labels: even posteriors
    for bad in ({}, {"en": -1.0, "fr": 2.0}, {"en": 0.0}):
        with pytest.raises(ValueError):
            mixing_rates(awkward, labels, bad)
