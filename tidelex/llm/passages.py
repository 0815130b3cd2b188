"""Removal of passages that occur more than once, located by repeated-phrase automata.

1. Ask: every window of ``window`` consecutive words is hashed; each chunk of documents asks the shard that owns a hash
   whether it starts anywhere else in the corpus. Windows that may recur make the candidates.
2. Cut: candidate windows in a row that hold the same seed (their least-hashed phrase of SEED_WORDS words) make a
   segment. Equal segments are one row in the corpus, however many documents hold them.
3. Compile and stream: a shard takes the segments of its seeds, wherever they come from. The first and the last window
   of each segment cover it; these phrases are compiled, over an alphabet of words, into Aho-Corasick automata, and all
   segments pass through them. A phrase found at two places or more, word by word, is a confirmed passage.
4. Remove: the places of confirmed phrases go back to the documents, and the words they cover are removed. What the
   automata do not find stays, so a collision of hashes removes nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, compress

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.blocks import U, chunked, gram_hashes, pack_sorted, shard_bounds, split_words, unpack_sorted, word_hashes
from tidelex.llm.common import kept

SEED_WORDS = 6
#: Most phrases in one automaton, which bounds its memory (about 5 KB a phrase of 35 words).
AUTOMATON_PHRASES = 20_000
#: Bytes of segments that one shard of phrases takes, and the least number of shards.
PHRASE_SHARD_BYTES, LEAST_PHRASE_SHARDS = 4 << 20, 48


def _within(counts: np.ndarray, n: int) -> np.ndarray:
    """Which positions of all words in a row start a sequence of n words within their document."""
    total = int(counts.sum())
    end = np.repeat(np.cumsum(counts), counts)
    return (np.arange(total) + n <= end)[: max(0, total - n + 1)]


class Chunk:
    """The distinct texts of a chunk in a fixed order, and their words in a row."""

    def __init__(self, texts: list[str]):
        copies = Counter(texts)
        self.texts = sorted(copies, key=lambda t: (len(t), t))
        self.parts, self.words, self.counts = split_words(self.texts)
        self.times = np.array([copies[t] for t in self.texts], np.int64)
        self.of = np.repeat(np.arange(len(self.texts)), self.counts)

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' hashes, where windows start, and the windows' hashes."""
        hashes = word_hashes(self.words)
        starts = np.flatnonzero(_within(self.counts, window))
        return hashes, starts, gram_hashes(hashes, window)[starts] if len(starts) else np.zeros(0, U)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``known`` ones."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def seeds_of(hashes: np.ndarray, window: int) -> np.ndarray:
    """The least hash of a seed phrase in the window from each position, by doubling the reach."""
    n = min(SEED_WORDS, window)
    least, reach, want = gram_hashes(hashes, n), 1, window - n + 1
    while reach < want:
        step = min(reach, want - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least


def segments(hashes: np.ndarray, starts: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """(first word, end, hash of the seed) of the runs of candidate windows with one seed, ``window`` of them at most."""
    if not len(starts):
        return
    seed = seeds_of(hashes, window)[starts]
    new = np.r_[True, (np.diff(starts) != 1) | (np.diff(seed) != 0)]
    since = np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
    new = np.flatnonzero(new | (since % window == 0))
    last = np.r_[new[1:], len(starts)] - 1
    yield from zip(starts[new].tolist(), (starts[last] + window).tolist(), seed[new].tolist(), strict=True)


def automata(phrases: list[tuple[bytes, ...]]) -> Iterator[tuple[ahocorasick.Automaton, dict[bytes, str], int]]:
    """Aho-Corasick automata of the phrases, with the spelling of their words and the number of the first phrase.

    A word is spelled by two letters of alphabets of their own, so no node has many children to search and no match
    can start within a word. Two characters 0 stand for any other word.
    """
    for at in range(0, len(phrases), AUTOMATON_PHRASES):
        part = phrases[at : at + AUTOMATON_PHRASES]
        words = set(chain.from_iterable(part))
        base = max(2, math.isqrt(len(words)) + 1)
        spelled = {w: chr(1 + i % base) + chr(1 + base + i // base) for i, w in enumerate(words)}
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, phrase in enumerate(part):
            machine.add_word("".join([spelled[w] for w in phrase]), i)
        machine.make_automaton()
        yield machine, spelled, at


def located(texts: list[bytes], times: list[int], window: int) -> list[list[int]]:
    """Of each segment at which words a phrase starts that occurs twice or more; ``times``: how often each segment occurs."""
    docs = [t.split() for t in texts]
    phrases = list({tuple(d[k : k + window]) for d in docs for k in (0, len(d) - window)})
    seen = [0] * len(phrases)
    hits: list[list[tuple[int, int]]] = [[] for _ in docs]
    for machine, spelled, first in automata(phrases):
        for doc, n, mine in zip(docs, times, hits, strict=True):
            known = "".join([spelled.get(w, "\0\0") for w in doc])
            for end, i in machine.iter(known):
                mine.append(((end + 1) // 2 - window, first + i))
                seen[first + i] += n
    return [[k for k, i in mine if seen[i] > 1] for mine in hits]


def sums_of_pairs(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """The sum of every number of a row's list in ``a`` with every number of its list in ``b``."""
    size_a, size_b = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    own = np.repeat(np.arange(len(a)), size_a)  # the row of each number in a
    times = size_b[own]
    step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    first = np.cumsum(size_b) - size_b
    left, right = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    return np.repeat(left, times) + right[np.repeat(first[own], times) + step]


def remove_repeated_passages(docs: DataFrame, window: int = 35, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs``, and with ``keep_text`` kept (words joined by a space).

    Words are runs without ASCII white space. A word goes if a window of ``window`` words of its document covers it
    whose sequence also starts anywhere else, the same document included; windows are judged on the input. Rows that
    repeat a document are two documents. A null or blank text has no words; a text shorter than the window keeps all.
    Long texts are one row like any other; their segments are dealt out. An empty table gives no rows. Only doc_id and
    text are read, so other columns may have any names.
    """
    rows, _, shards = chunked(docs)

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        chunk = Chunk(group["text"].to_pylist())
        _, starts, keys = chunk.windows(window)
        held, place = np.unique(keys, return_inverse=True)
        count = np.bincount(place, weights=chunk.times[chunk.of[starts]], minlength=len(held)) if len(held) else np.zeros(0)
        at = shard_bounds(held, shards)
        used = [s for s in range(shards) if at[s] < at[s + 1]]
        return pa.table({
            "shard": pa.array(used, pa.int32()),
            "asker": pa.array([key[0].as_py()] * len(used), pa.int32()),
            "keys": pa.array([pack_sorted(held[at[s] : at[s + 1]]) for s in used], pa.binary()),
            "again": pa.array([np.packbits(count[at[s] : at[s + 1]] > 1).tobytes() for s in used], pa.binary()),
        })

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        asked = [unpack_sorted(x) for x in group["keys"].to_pylist()]
        again = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(group["again"].to_pylist(), asked, strict=True)]
        held, count = np.unique(np.concatenate([*asked, *[k[a] for k, a in zip(asked, again, strict=True)]]), return_counts=True)
        twice = held[count > 1]
        return pa.table({"chunk": group["asker"], "keys": pa.array([pack_sorted(k[among(k, twice)]) for k in asked], pa.binary())})

    def cut_out(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(group["text"].to_pylist())
        hashes, starts, keys = chunk.windows(window)
        known = np.sort(np.concatenate([np.zeros(0, U), *[unpack_sorted(x) for x in answers["keys"].to_pylist()]]))
        starts = starts[among(keys, known)]
        places: dict[bytes, list[int]] = defaultdict(list)
        shard: dict[bytes, int] = {}
        for begin, end, seed in segments(hashes, starts, window):
            text = b" ".join(chunk.words[begin:end])
            places[text].append(begin)
            shard[text] = seed & 0x7FFFFFFFFFFFFFFF
        weight = chunk.times[chunk.of].tolist()
        n = [sum([weight[i] for i in p]) for p in places.values()]
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(places), pa.int32()), "seed": pa.array([shard[t] for t in places], pa.int64()), "segment": pa.array([xxhash.xxh3_128_digest(t) for t in places], pa.binary()),
            "words": pa.array(list(places), pa.binary()), "times": pa.array(n, pa.int64()), "places": pa.array(list(places.values()), pa.list_(pa.int32())),
        })

    def stream(key: tuple, group: pa.Table) -> pa.Table:
        found = located(group["words"].to_pylist(), group["times"].to_pylist(), window)
        return pa.table({"segment": group["segment"], "starts": pa.array(found, pa.list_(pa.int32()))})

    def remove(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        texts = group["text"].to_pylist()
        chunk = Chunk(texts)
        edge = np.zeros(len(chunk.words) + 1, np.int32)
        at = sums_of_pairs(found["places"].combine_chunks(), found["starts"].combine_chunks())
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        made: dict[str, tuple[int, int, str, bytes]] = {}
        at = 0
        for text, doc in zip(chunk.texts, chunk.parts, strict=True):
            mask = gone[at : at + len(doc)]
            at += len(doc)
            removed = int(mask.sum())
            left = b" ".join(compress(doc, ~mask) if removed else doc)
            made[text] = (len(doc), removed, hashlib.sha256(left).hexdigest(), left if keep_text else b"")
        out = [made[t] for t in texts]
        cols = {"doc_id": group["doc_id"], "n_words": pa.array([x[0] for x in out], pa.int64()), "n_removed": pa.array([x[1] for x in out], pa.int64()), "kept_sha256": pa.array([x[2] for x in out], pa.string())}
        return pa.table(cols | ({"kept": pa.array([x[3].decode("utf-8", "surrogatepass") for x in out], pa.string())} if keep_text else {}))

    asked = rows.groupBy("chunk").applyInArrow(ask, "shard int, asker int, keys binary, again binary")
    answers = asked.groupBy("shard").applyInArrow(answer, "chunk int, keys binary")
    made = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut_out, "chunk int, seed long, segment binary, words binary, times long, places array<int>")
    made = kept(made, "segments")
    size = made.agg(F.sum(F.octet_length("words")).alias("n")).first().n or 0
    n = max(LEAST_PHRASE_SHARDS, -(-size // PHRASE_SHARD_BYTES))
    distinct = made.groupBy("seed", "segment").agg(F.first("words").alias("words"), F.sum("times").alias("times")).withColumn("shard", F.pmod("seed", F.lit(n)).cast("int"))
    found = distinct.select("shard", "segment", "words", "times").groupBy("shard").applyInArrow(stream, "segment binary, starts array<int>").where(F.size("starts") > 0)
    back = made.select("chunk", "segment", "places").join(found, "segment").select("chunk", "places", "starts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(remove, schema)
