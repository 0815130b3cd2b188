"""Maximal periodic runs of words, found on suffix trees of the documents.

Stoye and Gusfield's method: a branching tandem repeat (two equal stretches of d words in a row, followed by a word
that breaks the period) is a pair of leaves that lie d words apart below a node of depth d, in different children. Of
every inner node the leaves of all children but the largest are looked at, which adds up to n log n leaves at most.
Each repeat is then rotated to the left as far as its period holds, and repeats that end up on the same stretch are
merged to one run of the smallest period.

A task builds one suffix forest for a few hundred thousand words of many documents at a time. Words are numbered
apart for each document, so no two documents share a branch. The forest is a suffix array with longest common
prefixes; its nodes are the intervals between smaller prefixes, and all steps are array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import text_or_empty

BATCH_WORDS = 1 << 18


def _ordered(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows (one array a column, values from 0 to the bound of the longest) sorted by all columns, first column first."""
    bits = max(1, *(int(k.max(initial=0)).bit_length() for k in keys))
    if bits * len(keys) > 63:
        at = np.lexsort(keys[::-1])
        return tuple(k[at] for k in keys)
    packed = keys[0].astype(np.int64)
    for k in keys[1:]:
        packed = packed << bits | k
    packed.sort()
    mask = (1 << bits) - 1
    return tuple(packed >> bits * (len(keys) - 1 - i) & mask for i in range(len(keys)))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def suffix_ranks(doc: np.ndarray, word: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks by the first 1, 2, 4 ... words of every suffix until no two are alike, and the suffix array.

    Suffixes have the same rank at level k if their first 2^k words are the same words of the same document. Each array
    of ranks has one more place, which is like no other.
    """
    n = len(word)
    if not n:
        return [np.full(1, -1)], np.zeros(0, np.int64)
    key, other, sa = _ordered(doc, word, np.arange(n))
    slots, levels = np.arange(n), []
    while True:
        new = _firsts(key, other)
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(new)])
        rank = levels[-1].copy() if levels else np.full(n + 1, -1)
        rank[sa[slots]] = slots[np.repeat(begin, size)]
        levels.append(rank)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return levels, sa
        at = sa[slots]
        key, other, sa[slots] = _ordered(rank[at], rank[at + (1 << len(levels) - 1)] + 1, at)


def common_prefixes(levels: list[np.ndarray], sa: np.ndarray) -> np.ndarray:
    """How many words each suffix of the array shares with the one before it; 0 for the first, and one more 0 behind the last."""
    a, b = sa[:-1], sa[1:]
    length = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels) - 1)):  # at the last level all differ
        live = np.flatnonzero(levels[k][a] == levels[k][b]) if not length.any() else np.flatnonzero((length > 0) | (levels[k][a] == levels[k][b]))
        same = levels[k][a[live] + length[live]] == levels[k][b[live] + length[live]]
        length[live[same]] += 1 << k
    return np.r_[0, length, 0] if len(sa) else np.zeros(1, np.int64)


def _smaller(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Of the places ``at`` the next place in the direction of ``step`` with a smaller value, by following each other's pointers."""
    to = np.arange(len(lcp)) + step
    live = at
    while len(live):
        live = live[lcp[to[live]] >= lcp[live]]
        to[live] = to[to[live]]
    return to[at]


def tandem_repeats(levels: list[np.ndarray], sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every branching tandem repeat; some come twice."""
    lcp, rank = common_prefixes(levels, sa), levels[-1]
    places = np.flatnonzero(lcp)
    if not len(places):
        return places, places
    low, high, place = _ordered(_smaller(lcp, places, -1), _smaller(lcp, places, 1), places)
    begin = np.flatnonzero(_firsts(low, high))  # of each node, in the sorted places that part its children
    node = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(place)]))
    last = np.r_[begin[1:], len(place)] - 1
    left, right = np.empty(len(place) + len(begin), np.int64), np.empty(len(place) + len(begin), np.int64)
    own = np.arange(len(place)) + node
    left[own + 1], right[own] = place, place
    left[begin + np.arange(len(begin))], right[last + np.arange(len(begin)) + 1] = low[begin], high[begin]
    child_of = np.repeat(np.arange(len(begin)), last - begin + 2)
    size = right - left
    largest = np.flatnonzero(size == np.maximum.reduceat(size, begin + np.arange(len(begin)))[child_of])
    small = np.ones(len(size), bool)
    small[largest[_firsts(child_of[largest])]] = False  # of children of the same size the first counts as the largest
    left, size, of = left[small], size[small], child_of[small]
    leaf = sa[np.repeat(left - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    depth = np.repeat(lcp[place[begin]][of], size)
    low, high = np.repeat(low[begin][of], size), np.repeat(high[begin][of], size)
    word = levels[0]
    starts, periods = [], []
    for first in (leaf, leaf - depth):  # a leaf may be the repeat's first half or its second
        ok = np.flatnonzero((first >= 0) & (first + depth < len(rank)))
        i, d = first[ok], depth[ok]
        other = rank[i + d] if first is leaf else rank[i]
        inside = np.flatnonzero((other >= low[ok]) & (other < high[ok]))
        i, d = i[inside], d[inside]
        broken = word[i + d] != word[i + 2 * d]
        starts.append(i[broken])
        periods.append(d[broken])
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(doc: np.ndarray, word: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all maximal runs, by start and then period. ``doc`` does not fall."""
    levels, sa = suffix_ranks(doc, word)
    start, period = tandem_repeats(levels, sa)
    end = start + 2 * period
    for k in reversed(range(len(levels))):  # rotate to the left while the word before is the one a period later
        back = start - (1 << k)
        ok = np.flatnonzero(back >= 0)
        ok = ok[levels[k][back[ok]] == levels[k][back[ok] + period[ok]]]
        start[ok] = back[ok]
    long = np.flatnonzero(end - start >= min_words)
    start, end, period = _ordered(start[long], end[long], period[long])
    first = np.flatnonzero(_firsts(start, end))
    start, period, length = _ordered(start[first], period[first], (end - start)[first])
    return start, length, period


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of the texts, a few hundred thousand at a time, with the number of the first text."""
    begin, held, parts = 0, 0, []
    for i, t in enumerate(texts):
        parts.append(t.split())
        held += len(parts[-1])
        if held >= BATCH_WORDS:
            yield begin, parts
            begin, held, parts = i + 1, 0, []
    if parts:
        yield begin, parts


def periodic_runs(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """doc_id, n_words, runs array<struct<start,length,period>> by start and period, collapsed: every row's periodic runs.

    A run is a stretch of consecutive words (``[^\\x20\\x09-\\x0D]+``) of smallest period q, at least ``min_words`` and
    2 q words long, that no neighbouring word extends. ``collapsed`` joins by one space the words that no run holds
    after its first q words. A null text counts as empty and has no words; a text without runs keeps all words.
    Repeated rows give repeated rows, a null doc_id stays null, an empty table gives no rows. A document of any length
    is one row of one task, which holds some 8 bytes a word for each doubling of its longest repeat. Only doc_id and
    text are read, so other columns may have any names. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, parts in _slices(b["text"].cast(pa.binary()).to_pylist()):
                flat = [w for p in parts for w in p]
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                first = np.cumsum(sizes) - sizes
                doc = np.repeat(np.arange(len(parts)), sizes)
                start, length, period = runs_of(doc, pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64), min_words)
                owner = doc[start]
                gone = np.zeros(len(flat) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                stay = np.cumsum(gone[:-1]) == 0
                for i in np.unique(owner).tolist():
                    parts[i] = [w for w, s in zip(parts[i], stay[first[i] : first[i] + sizes[i]].tolist(), strict=True) if s]
                offsets = pa.array(np.searchsorted(owner, np.arange(len(parts) + 1)).astype(np.int32))
                found = pa.StructArray.from_arrays([pa.array(x) for x in (start - first[owner], length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b["doc_id"].slice(begin, len(parts)), "n_words": pa.array(sizes), "runs": pa.ListArray.from_arrays(offsets, found),
                    "collapsed": pa.array([b" ".join(p) for p in parts], pa.binary()).cast(pa.string()),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id, text, where of one document in ten (by the CRC-32 of its id) all words from some place on repeat a stretch.

    With h the CRC-32 and g = floor(h / 10), the n words from a = g % n on become the first 1 + floor((n - a) / (3 + g % 8))
    of them, over and over. Null and wordless texts and rows without doc_id stay as they are.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("long").cast("string")).alias("h"))
    hit = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = own.withColumn("words", F.when(hit, words)).withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    left = (F.col("n") - F.col("a")).cast("int")
    period = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    over = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), over), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))
