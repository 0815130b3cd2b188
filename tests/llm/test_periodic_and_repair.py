"""Compression quality, periodic runs and turn repair: held-out accuracy and plain second implementations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidelex.llm import compression_quality, queries, turn_repair
from tidelex.llm.common import table
from tidelex.llm.compression_quality import CompressionModel, chosen_pieces, dictionary, fit, fit_curve, labelled_sample, pieces, score
from tidelex.llm.tandem_runs import looped, periodic_runs, runs_of

from ..conftest import DATA
from .conftest import CLASHING, PAIRS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LARGE = f"{DATA}/sf0.1"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# compression classifier


def test_quality_held_out(spark):
    found = queries.op11_compression_quality(spark, LARGE)
    rows = found.join(table(spark, LARGE, "labels").select("doc_id", "quality"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r for r in held if r.quality], [r for r in held if not r.quality]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.93 * len(bad)
    # calibrated: among held-out rows the mean score is the share of good ones
    assert abs(np.mean([r.score for r in held]) - len(good) / len(held)) < 0.02


def test_quality_differences_by_hand(spark, small):
    """The sizes with either dictionary summed up plainly, and the curve by a grid around the one found."""
    model = fit(labelled_sample(table(spark, small, "documents"), table(spark, small, "labels")))
    texts = {r.doc_id: r.text or "" for r in table(spark, small, "documents").select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in score(table(spark, small, "documents"), model).collect()}
    size = lambda held, text: sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held), write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[i : i + 512])) for i in range(0, len(text), 512))
    assert len(found) == len(texts)
    for i in sorted(texts)[:60]:
        data = texts[i].encode()
        want = (size(model.bad, data) - size(model.good, data)) / (len(data) + 32)
        assert abs(found[i].difference - want) < 1e-12
        assert abs(found[i].score - 1 / (1 + np.exp(-(model.slope * want + model.bias)))) < 1e-9


def test_curve_is_the_minimum():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0.05, 0.03, 300), rng.normal(-0.02, 0.03, 80)]
    y = np.r_[np.ones(300), np.zeros(80)]
    slope, bias = fit_curve(x, y)
    loss = lambda s, b: np.mean(np.logaddexp(0, -(2 * y - 1) * (s * x + b))) + 1e-4 * (s * x.std()) ** 2
    assert all(loss(slope, bias) <= loss(slope * a, bias + b) + 1e-12 for a in (0.99, 1, 1.01) for b in (-0.01, 0, 0.01))


def test_quality_awkward(spark, awkward, none):
    labels = spark.createDataFrame([(5, 1), (6, 1), (7, 1), (10, 0), (11, 0), (12, 0), (13, 1), (4, 0), (None, 1), (8, None)], "doc_id long, quality int")
    model = fit(labelled_sample(awkward, labels))
    rows = score(awkward, model).collect()
    assert len(rows) == len(PAIRS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2,)}) == 1 and [r.difference for r in rows if r.doc_id == 1] == [0.0]
    kept = score(awkward, model, keep="goodness")
    assert kept.columns == [*awkward.columns, "goodness"] and kept.count() == len(PAIRS)
    assert score(none, model).count() == 0
    for docs, made in ((none, labels), (awkward, labels.limit(0)), (awkward, labels.where("quality = 1"))):
        base = fit(labelled_sample(docs, made))
        assert (base.good, base.slope) == (b"", 0.0) and score(awkward, base).count() == len(PAIRS)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"t{i}") for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, train=F.col("doc_id") % 2 == 0, sample_rows=10).collect()
    assert len(rows) == 40 and len({r.doc_id for r in rows}) == 10 and all(r.doc_id % 2 == 0 for r in rows)


def test_dictionaries():
    assert dictionary([b"few"]) == b"few" and dictionary([]) == b""
    assert len(dictionary([f"some text number {i} of many ".encode() * 9 for i in range(400)])) <= compression_quality.DICT_BYTES
    text = "ä" * 1000
    assert b"".join(pieces(text)) == text.encode() and len(chosen_pieces(text, 2)) == 2
    assert CompressionModel().differ()("x") == 0.0


# periodic runs


def runs_by_hand(w, least):
    """Every period's stretches of words that are the same one period on; of one stretch the smallest period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e - s) for (s, e), q in found.items())


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(rnd.randint(0, 5)):
            n, kinds = rnd.randint(0, 70), rnd.randint(1, 4)
            w = [rnd.randint(0, kinds) for _ in range(n)]
            if rnd.random() < 0.5 and n > 4:
                a = rnd.randrange(n)
                p = rnd.randint(1, max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        least = rnd.choice([2, 5, 12])
        doc, word = (np.array(x, np.int64) for x in ([i for i, w in enumerate(docs) for _ in w], [x for w in docs for x in w]))
        start, length, period = runs_of(doc, word, least)
        want, at = [], 0
        for w in docs:
            want += [(s + at, q, n) for s, q, n in runs_by_hand(w, least)]
            at += len(w)
        assert list(zip(start.tolist(), period.tolist(), length.tolist(), strict=True)) == want


def looped_by_hand(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None or not w or zlib.crc32(str(doc_id).encode()) % 10:
        return w
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_query_by_brute_force(spark, small):
    found = {r.doc_id: r for r in queries.op12_periodic_runs(spark, small).collect()}
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").select("doc_id", "text").collect()}
    assert len(found) == len(texts)
    some = 0
    for i, text in texts.items():
        w = looped_by_hand(i, text)
        if len(w) > 2500:  # the plain search is quadratic; long texts are held to rules below
            continue
        runs = runs_by_hand(w, 12)
        best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
        s, q, n = best or (None, None, None)
        lines = "".join(f"{a},{c},{b}\n" for a, b, c in runs)
        assert tuple(found[i][1:]) == (len(runs), s, n, q, best and 1000 * n // q, sha(lines), sha(collapsed(w, runs))), i
        some += len(runs)
    assert some > 20


def test_runs_in_long_texts(spark, frame):
    """Planted runs in texts too long for the plain search."""
    rnd = random.Random(1)
    noise = [f"w{i}" for i in range(60_000)]
    rnd.shuffle(noise)
    base = [f"p{i}" for i in range(700)]
    long = noise[:30_000] + (base * 40)[:25_000] + ["x"] * 5_000 + noise[30_000:]
    rows = periodic_runs(frame((1, " ".join(long)), (2, "\n".join(["a b"] * 300_000)), (3, " ".join(noise)))).collect()
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in rows}
    assert found == {1: [(30_000, 25_000, 700), (55_000, 5_000, 1)], 2: [(0, 600_000, 2)], 3: []}
    assert {r.doc_id: r.collapsed for r in rows}[2] == "a b"


def test_runs_awkward(spark, awkward, none):
    rows = periodic_runs(awkward, min_words=3).collect()
    assert sorted(map(str, [(r.doc_id, r.n_words) for r in rows])) == sorted(map(str, [(i, len(WORD.findall(t or ""))) for i, t in PAIRS]))
    for r in rows:
        if r.n_words < 2000:
            texts = [WORD.findall(t or "") for i, t in PAIRS if i == r.doc_id and len(WORD.findall(t or "")) == r.n_words]
            assert r.collapsed in [collapsed(w, runs_by_hand(w, 3)) for w in texts]
    assert periodic_runs(none).count() == 0 and looped(none).count() == 0
    assert {r.doc_id: r.text for r in looped(awkward).where("doc_id = 1 or doc_id = 2").collect()} == {1: None, 2: ""}


# turn repair


def damaged_by_hand(rows):
    out = defaultdict(list)
    one = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        held = out[conv]
        role, text = one(role), one(text)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired) by a search over whole audit strings, turn by turn, one inserted turn at a time."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    live, seen = {"": (0, "", ())}, set()

    def insert(states):
        states = dict(states)
        for _ in range(3):
            for at, (cost, audit, made) in list(states.items()):
                for role in ("user", "assistant"):
                    to, found = step.get((at, role[0])), (cost + 2, audit + "I", (*made, f"{role}:"))
                    if to is not None and (to not in states or found[:1] < states[to][:1]):
                        states[to] = found
        return states

    for role, text in turns:
        body = text.strip(" \t\n\v\f\r")
        must = not body or (role, text) in seen
        seen.add((role, text))
        extra = int(not must and body[-1] not in ".!?")
        options = defaultdict(list)
        # inserts before the turn: from every state on its own, as the least string of a state need not come first after them
        for start, found in live.items():
            for at, (cost, audit, made) in insert({start: found}).items():
                options[at].append((cost + 3, audit + "D", made))
                if not must:
                    for new, price, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                        if (to := step.get((at, new[:1]))) is not None:
                            options[to].append((cost + price + extra, audit + letter, (*made, f"{new}:{text}")))
        live = {at: min(found) for at, found in options.items()}
    ends = [x for start, found in live.items() for at, x in insert({start: found}).items() if at in ("", "a")]
    cost, audit, made = min(ends)
    return cost, audit, "\n".join(made)


def report_by_hand(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))
    blank = duplicate = truncated = 0
    seen = set()
    for _, role, text in turns:
        body = text.strip(" \t\n\v\f\r")
        if not body:
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
        elif body[-1] not in ".!?":
            truncated += 1
        seen.add((role, text))
    known = [t for t, _, _ in turns if t is not None]
    gap = max(known) - min(known) + 1 - len(set(known)) if known else 0
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    cost, audit, repaired = cheapest([t[1:] for t in turns])
    return gap, blank, duplicate, truncated, bad, cost, audit, sha(repaired)


def test_repair_query_by_brute_force(spark, middle):
    rows = [tuple(r) for r in table(spark, middle, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: report_by_hand(turns) for conv, turns in damaged_by_hand(rows).items()}
    found = {r.conv_id: tuple(r[1:]) for r in queries.op13_turn_repair(spark, middle).collect()}
    assert found == want
    assert sum(w[5] > 0 for w in want.values()) > 20


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
TEXTS = ["a.", "b!", "c", "", "d? ", " \t", "e f", None, "g.", "h.", "i.", "j"]


@pytest.fixture(scope="module")
def messy(spark):
    """Long, null and empty conversations with unlike turns at each number."""
    rnd, rows = random.Random(4), []
    for conv in [*range(40), None]:
        for turn in rnd.sample(range(400), rnd.choice([1, 2, 5, 9, 60, 200])):
            rows.append((conv, turn, rnd.choice(ROLES), rnd.choice(TEXTS) if rnd.random() < 0.4 else f"{rnd.random()}{rnd.choice(['.', '!', ''])}"))
    rows.append((99, None, "user", "only."))
    clash = ", ".join(f"{c} string" for c in [*CLASHING, "absent", "tie", "own", "said", "turns", "part", "no", "open"] if c not in ("conv_id", "turn", "role", "text"))
    extra = ["x"] * (clash.count(" string"))
    return rows, spark.createDataFrame([(*r, *extra) for r in rows], f"conv_id long, turn long, role string, text string, {clash}").repartition(5)


@pytest.mark.parametrize("most", [3, 1024])
def test_repair_in_segments(messy, most):
    """Conversations of many segments and of one come out alike, as the plain search has them."""
    rows, frame = messy
    want = {conv: report_by_hand(turns) for conv, turns in damaged_by_hand(rows).items()}
    turns, dropped = turn_repair.damaged(frame)
    found = {r.conv_id: tuple(r[1:]) for r in turn_repair.repair_report(turns, dropped, segment_turns=most).collect()}
    assert found == want


def test_repaired_blocks(messy, spark):
    rows, frame = messy
    blocks = turn_repair.repaired_blocks(frame, segment_turns=3).orderBy("conv_id", "part", "no").collect()
    made = defaultdict(list)
    for b in blocks:
        made[b.conv_id] += [t["role"][:1] for t in b.turns]
        assert len(b.audit.replace("I", "")) <= 3
    assert set(made) == {r[0] for r in rows} and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in made.values())
    assert sum(b.facts is not None for b in blocks) == len(made)
    assert turn_repair.repair_report(frame.limit(0)).count() == 0


def test_repair_of_one_turn_many_times(spark):
    """Equal rows of one conversation lie in several ranges; one stays."""
    frame = spark.createDataFrame([(1, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string").crossJoin(spark.range(5000)).drop("id")
    (row,) = turn_repair.repair_report(frame, segment_turns=100).collect()
    assert (row.duplicate, row.gaps, row.illegal, row.cost) == (4999, 0, 4999, 3 * 4999 + 2) and sorted(row.audit) == sorted("K" + "I" + "D" * 4999)
    assert row.repaired_sha256 == sha("user:Hello.\nassistant:")


def test_repair_of_all_dropped(spark):
    rows = spark.createDataFrame([(5, 1, "user", "a."), (5, 2, "assistant", "b."), (6, 1, "user", "x" * 200_000 + ".")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: tuple(r[1:]) for r in turn_repair.repair_report(rows, absent=F.col("conv_id") == 5).collect()}
    assert found[5] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert found[6] == (0, 0, 0, 0, 0, 2, "KI", sha("user:" + "x" * 200_000 + ".\nassistant:"))
