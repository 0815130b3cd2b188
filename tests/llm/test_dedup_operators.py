"""Exact, passage, line-run and SimHash deduplication against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelex.llm import passages, queries
from tidelex.llm.blocks import word_hashes
from tidelex.llm.common import table
from tidelex.llm.components import components
from tidelex.llm.exact_dedup import DigestIndex, drop_exact_duplicates, exact_duplicates
from tidelex.llm.line_runs import remove_repeated_runs, repeated_runs, suffix_levels
from tidelex.llm.passages import remove_repeated_passages
from tidelex.llm.simhash import BITS, SMALL_BUCKET, drop_near_duplicates, fingerprint, near_duplicates, near_links, ring_keys, viable

from .conftest import LONG, PAIRS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def utf8(s: str) -> bytes:
    return s.encode("utf-8", "surrogatepass")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, check_sql, name):
    check_sql(queries.QUERIES[name](spark, small), queries.ORACLE_SQL[name], small)


# exact


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_awkward(awkward, keep):
    groups = defaultdict(list)
    for i, t in PAIRS:
        groups[t or ""].append(i)
    want = Counter()
    for (i, t), n in Counter((i, t or "") for i, t in PAIRS).items():
        ids = [x for x in groups[t] if x is not None]
        best = (min if keep == "smallest" else max)(ids) if ids else None
        want[(i, best, len(groups[t]), i == best, hashlib.sha256(utf8(t)).hexdigest(), n)] += 1
    assert Counter(map(tuple, exact_duplicates(awkward, keep).collect())) == want


def test_exact_verifies_bytes(frame):
    """A digest that stands for several texts is split by text."""
    docs = frame((1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c"), (6, None), (6, ""))
    bad = lambda text: F.sha2(F.substring(text, 1, 0), 256)  # noqa: E731  the same for all texts
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.n_rows) for r in exact_duplicates(docs, "largest", digest=bad).collect()}
    assert got == {(1, 3, 2, False, 1), (3, 3, 2, True, 1), (2, 4, 2, False, 1), (4, 4, 2, True, 1), (5, 5, 1, True, 1), (6, 6, 2, True, 2)}


def test_exact_drop_and_empty(awkward, none):
    kept = drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in PAIRS})
    assert exact_duplicates(none).count() == drop_exact_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        exact_duplicates(none, keep="any")


def test_digest_index(spark):
    index = DigestIndex(spark, keep="largest", memtables=3)
    digest = F.unhex(F.sha2((F.col("id") % 10).cast("string"), 256))
    for at in (0, 100, 200):  # three flushes, which compaction merges
        index.insert(spark.range(at, at + 100).select("id", digest.alias("digest")))
    assert len(index.runs) == 3
    index.compact()
    assert len(index.runs) == 1
    assert sorted((r.keep_id, r.n) for r in index.read().collect()) == [(290 + k, 30) for k in range(10)]
    assert [r.keep_id for r in index.find([hashlib.sha256(b"4").digest()]).collect()] == [294]


# passages


def passages_by_hand(pairs, window):
    docs = [(i, WORD.findall(t or "")) for i, t in pairs]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(utf8(" ".join(x for k, x in enumerate(w) if k not in gone))).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [1, 3, 8, 35])
def test_passages_awkward(frame, window):
    rng = np.random.default_rng(3)
    few = [" ".join(rng.choice(["a", "b", "c", "d", "é"], n)) for n in (0, 1, 7, 34, 35, 36, 80, 200)]
    shared = " ".join(f"s{k}" for k in range(60))
    pairs = [*PAIRS[:13], *PAIRS[15:], *((100 + k, t) for k, t in enumerate(few)), (200, f"x {shared} y"), (201, f"{shared} {shared}"), (202, f"z {shared}"), (203, "r " * 90)]
    got = remove_repeated_passages(frame(*pairs), window=window).collect()
    assert Counter(map(tuple, got)) == passages_by_hand(pairs, window)


def test_passages_whole_table(spark, small):
    pairs = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.op2_repeated_passages(spark, small).collect()) == passages_by_hand(pairs, 35)


def test_passages_keep_text_and_empty(frame, none):
    row = remove_repeated_passages(frame((1, LONG)), keep_text=True).first()
    assert hashlib.sha256(utf8(row.kept)).hexdigest() == row.kept_sha256
    assert remove_repeated_passages(none).count() == 0


# lines


def runs_by_hand(pairs, least):
    docs = {(i is not None, i or 0, t or "") for i, t in pairs}  # rows that repeat id and text are one document
    docs = [(i if known else None, t) for known, i, t in docs]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest(utf8(d[1]), seed=42)))))  # Spark's xxhash64
    docs = [(i, t.split("\n")) for i, t in docs]
    first, gone = {}, defaultdict(set)
    for k, (_, lines) in enumerate(docs):
        for at in range(len(lines) - least + 1):
            doc, line = first.setdefault(tuple(lines[at : at + least]), (k, at))
            if doc != k or at >= line + least:
                gone[k].update(range(at, at + least))
    return {(i, tuple(lines)): "\n".join(x for at, x in enumerate(lines) if at not in gone[k]) for k, (i, lines) in enumerate(docs)}, {(i, tuple(lines)): len(gone[k]) for k, (i, lines) in enumerate(docs)}


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_runs(frame, least):
    rng = np.random.default_rng(5)
    texts = ["\n".join(rng.choice(["p", "q", "r", ""], n)) for n in (1, 2, 4, 9, 20, 20)]
    shared = "\n".join(f"shared {k}" for k in range(12))
    pairs = [*PAIRS, (None, "line a\nline b\nline c\nline d"), (9, "line b\nline c\nline d\nz"), (60, "A\nA\nA\nA\nz"), (61, "\n".join("ABABABABAB") + "\nz"), (62, "\n".join("A" * 9))] + [(50 + k, t) for k, t in enumerate(texts)] + [(80, shared), (81, f"x\n{shared}\ny"), (82, f"{shared}\n{shared}")]
    kept, n = runs_by_hand(pairs, least)
    want = Counter((i, len((t or "").split("\n")), n[i, tuple((t or "").split("\n"))], kept[i, tuple((t or "").split("\n"))]) for i, t in pairs)
    assert Counter(map(tuple, remove_repeated_runs(frame(*pairs), least).collect())) == want


def test_first_occurrence_stays_whole(frame):
    got = {r.doc_id: r.kept for r in remove_repeated_runs(frame((1, "A\nA\nA\nA\nz"), (2, "\n".join("B" * 7)), (3, "\n".join("CDCDCDCDz"))), 3).collect()}
    assert got == {1: "A\nA\nA\nA\nz", 2: "B\nB\nB", 3: "\n".join("CDCDz")}


def test_line_runs_are_maximal(frame, none):
    shared = "\n".join(f"shared {k}" for k in range(12))
    runs = repeated_runs(frame((1, f"{shared}\nend"), (2, f"a\n{shared}\nb"), (3, f"shared 1\n{shared}")), 3).collect()
    assert {(r.doc_id, r.start, r.length, r.first_doc, r.first_line) for r in runs} == {(2, 1, 12, 1, 0), (3, 1, 12, 1, 0)}
    assert remove_repeated_runs(none).count() == 0


def test_levels_end_with_the_longest_run(frame):
    shared = "\n".join(f"shared {k}" for k in range(37))
    levels = suffix_levels(frame((1, shared), (2, f"a\n{shared}\nb")), 8)
    assert [level.count() for level in levels] == [74, 72, 68, 60, 44, 12, 0]


def test_line_runs_take_few_jobs(spark, frame):
    """A level of doubling and one of the common prefixes are small for deep runs, so what counts is how many jobs wait for each other."""
    shared = "\n".join(f"shared {k}" for k in range(200))
    docs = frame((1, shared), (2, f"a\n{shared}\nb"))
    spark.sparkContext.setJobGroup("line runs", "")
    try:
        assert [(r.doc_id, r.start, r.length) for r in repeated_runs(docs, 3).collect()] == [(2, 1, 200)]
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("line runs")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 130


# simhash


def fingerprint_by_hand(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(lower)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(utf8(s), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(fps: dict[int, int]) -> dict[int, int]:
    """Components over all pairs of ids."""
    up = {i: i for i in fps}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids, values = list(fps), np.array(list(fps.values()), np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= BITS):
            a, b = top(i), top(ids[k + 1 + int(j)])
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in fps}


def test_simhash_whole_table(spark, middle):
    docs = {r.doc_id: r.text for r in table(spark, middle, "documents").select("doc_id", "text").collect()}
    fps = {i: fingerprint_by_hand(t) for i, t in docs.items()}
    want = classes(fps)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op4_simhash(spark, middle).collect()}
    assert got == {i: (fps[i], want[i]) for i in docs}


def test_simhash_awkward(awkward, none):
    got = near_duplicates(awkward).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter((i, fingerprint_by_hand(t)) for i, t in PAIRS)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id in (2, 3, 11, 14)").count() == 0 and kept.where("doc_id is null").count() == 2
    assert near_duplicates(none).count() == drop_near_duplicates(none).count() == 0
    assert fingerprint(LONG) == fingerprint_by_hand(LONG)


def test_pigeonring_misses_nothing(spark):
    """Random fingerprints with neighbours at 0 to 6 bits, and a bucket too large to compare all at once."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 300, np.uint64)
    near = base.copy()
    for k in range(len(base)):
        for b in rng.choice(64, k % 7, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    crowd = np.uint64(0xABCDEF0123456789) ^ (rng.integers(0, 1 << 16, 4 * SMALL_BUCKET, np.uint64) << np.uint64(7))
    values = np.unique(np.r_[base, near, crowd])
    fps = {i: int(v) for i, v in enumerate(values)}
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), i) for i, v in fps.items()], "fp long, node long")
    found = {r.node: r.component for r in components(near_links(nodes, 8)).collect()}
    assert {i: found.get(i, i) for i in fps} == classes(fps)


def test_pigeonring_chains():
    """Every pair within the budget meets under a key whose chains it passes."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 500, np.uint64)
    b = a.copy()
    for k in range(len(a)):
        for bit in rng.choice(64, int(rng.integers(0, BITS + 1)), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    met = np.zeros(len(a), bool)
    for s, (x, y) in enumerate(zip(ring_keys(a), ring_keys(b), strict=True)):
        met |= (x == y) & viable(a, b, np.full(len(a), s))
    assert met.all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5), (9, 8), (8, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 7 for k in [7, *range(200, 260)]} | {8: 8, 9: 8}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_of_colliding_patterns(frame):
    """Words that a polynomial hash modulo 2^64 cannot tell apart (Thue-Morse patterns of two letters)."""
    signs = [bin(k).count("1") % 2 for k in range(2048)]
    one, two = ("".join("ab"[x ^ flip] for x in signs) for flip in (0, 1))
    assert len({int(x) for x in word_hashes([one.encode(), two.encode(), (one + two).encode(), (two + one).encode()])}) == 4
    tail = [f"t{k}" for k in range(34)]
    rows = [(1, " ".join([one, *tail])), (2, " ".join([two, *tail]))]
    assert {r.n_removed for r in remove_repeated_passages(frame(*rows), window=35).collect()} == {0}
    pattern = [" ".join("xy"[x ^ flip] for x in signs[:64]) for flip in (0, 1)]
    assert {r.n_removed for r in remove_repeated_passages(frame((1, pattern[0]), (2, pattern[1])), window=64).collect()} == {0}


def test_automata_decide(monkeypatch):
    texts = [b"a b c d e", b"x a b c d", b"q r s t"]
    assert passages.located(texts, [1, 1, 1], 3) == [[0, 1], [1, 2], []]
    assert passages.located([b"q r s t"], [2], 3) == [[0, 1]]
    monkeypatch.setattr(passages, "automata", lambda phrases: iter(()))
    assert passages.located(texts, [1, 1, 1], 3) == [[], [], []]


def test_passages_of_long_texts(frame):
    pairs = [*PAIRS, (30, LONG.replace("word7 ", "other ")), (31, "x " * 40 + LONG[:5000])]
    assert Counter(map(tuple, remove_repeated_passages(frame(*pairs)).collect())) == passages_by_hand(pairs, 35)
