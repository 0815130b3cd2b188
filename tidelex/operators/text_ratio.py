"""Pairs of texts at a Ratcliff-Obershelp ratio (difflib's, with its popular characters) of a threshold or more.

The ratio of a and b is 2 M / (|a| + |b|) with M the characters in matching blocks. Bounds keep most pairs from being
matched block by block, and none loses a pair:

- M is at most the characters that the texts have in common as multisets, wherever they stand.
- Every block holds all its runs of q characters in both texts, so the texts have M - K (q - 1) of them in common, as
  multisets, where K is the number of blocks. Two blocks in a row have an unmatched character between them, so K is at
  most |a| + |b| - 2 M + 1. If b has 200 characters or more, difflib starts blocks only at characters that make up a
  hundredth of b at most, but for one block at the very beginning; so K is at most 1 and their number in b, or what a has of them.

Sketches come before runs: a text's runs turn over the bits they fall on, so two sketches differ in no more bits than there
are runs that only one of the texts holds, and these are |a| + |b| - 2 (q - 1) less twice the runs in common. A sketch is compared
folded to a quarter first, then whole; few pairs go on to their runs. Pairs that are left are matched only
until it is clear on which side of the threshold their ratio lies.
"""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Characters of a run; where a text of a tile is long, runs of five are too common to tell texts of a language apart.
Q, LONG_Q, LONG_TEXT = 5, 7, 5000
#: Where more texts than these are left for a text, folded sketches are compared before whole ones.
HOT_TEXTS = 64
#: Sketches have 8 bits a character of the longest text; those of short texts, which may miss more of their runs, up to 32.
SKETCH_BITS, SHORT_BITS, FOLD = 8, 6400, 4
#: Characters of runs that a tile keeps, and pairs of equal characters that a matcher holds (some 60 bytes each).
KEPT_RUNS, PAIRS = 2_000_000, 1 << 21
#: Groups of characters by their lowest bits, in which they are counted.
GROUPS, FEW = 128, 32
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(text: str, q: int = Q) -> np.ndarray:
    """A hash of each run of q characters, in the order of the text."""
    c = points(text).astype(U)
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, U)
    h = c[:n].copy()
    for i in range(1, q):
        h *= STEP
        h += c[i : i + n]
    h ^= h >> U(29)
    return h


def run_codes(text: str, q: int = Q) -> np.ndarray:
    """Codes of the text's runs of q characters; the second, third ... of equal runs have codes of their own.

    Different runs may share a code, which only raises what two texts seem to have in common.
    """
    h = hashes(text, q)
    n = len(h)
    if not n:
        return h
    h.sort()
    at = np.arange(n)
    first = at.copy()
    first[1:] *= h[1:] != h[:-1]
    again = at - np.maximum.accumulate(first)
    return h + again.astype(U) * U(0xC2B2AE3D27D4EB4F)


def runs(text: str, q: int = Q) -> np.ndarray:
    """``run_codes`` in order."""
    return np.sort(run_codes(text, q))


def characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """How many characters of each group the text has, and how many of them difflib may start a block at if it is the earlier one: those of a long text that are rare in it, all of a text under 200."""
    n = np.bincount(c) if (c := points(text)).max(initial=0) < 1 << 12 else None
    x, n = np.unique(c, return_counts=True) if n is None else (np.arange(len(n)), n)
    every = np.bincount(x % GROUPS, weights=n, minlength=GROUPS)
    return every, np.bincount(x % GROUPS, weights=np.where(n <= len(text) // 100 + 1, n, 0), minlength=GROUPS) if len(text) >= 200 else every


def sketch(text: str, bits: int, q: int = Q) -> np.ndarray:
    """Words of ``bits`` bits, each the parity of the runs that fall on it."""
    at = (run_codes(text, q) * U(0xD6E8FEB86659FD93) >> U(32)) * U(bits) >> U(32)
    fell = np.zeros(bits, np.uint8)
    np.add.at(fell, at.astype(np.int64), np.uint8(1))
    return np.packbits(fell & 1).view(U)


@dataclass
class Tile:
    """Texts that are compared with each other, and the sketches of their runs, a column a text."""

    texts: list[str]

    def __post_init__(self) -> None:
        self.size = np.array([len(t) for t in self.texts], np.int64)
        most = int(self.size.max(initial=0))
        self.q = LONG_Q if most >= LONG_TEXT else Q
        self.n_runs = np.maximum(self.size - (self.q - 1), 0)
        self.all, self.rare = (np.zeros((len(self.texts), GROUPS), np.int32) for _ in range(2))
        bits = max(SKETCH_BITS * most, min(SHORT_BITS, 4 * SKETCH_BITS * most), 1)
        words = -(-bits // (64 * FOLD)) * FOLD
        self.whole = np.zeros((len(self.texts), words), U)
        texts, q = self.texts, self.q
        self.runs = lru_cache(max(16, KEPT_RUNS // max(most, 1)))(lambda i: runs(texts[i], q))
        for i, t in enumerate(self.texts):
            self.whole[i] = sketch(t, 64 * words, self.q)
            self.all[i], self.rare[i] = characters(t)
        self.folded = np.bitwise_xor.reduce(self.whole.reshape(len(self.texts), FOLD, words // FOLD), axis=1).T
        self.few = np.ascontiguousarray(self.all.reshape(len(self.texts), GROUPS // FEW, FEW).sum(axis=1, dtype=np.int32).T)

    def overlaps(self, i: int, others: np.ndarray | None = None) -> np.ndarray:
        """How many runs text i has in common with each of the ``others``, by default with each text."""
        places = range(len(self.texts)) if others is None else others.tolist()
        return np.fromiter((len(np.intersect1d(self.runs(i), self.runs(j), assume_unique=True)) for j in places), np.int64, len(places))

    def candidates(self, i: int, begin: int, end: int, meet: np.ndarray, threshold: float) -> np.ndarray:
        """Of the texts from ``begin`` to ``end`` that ``meet`` marks, none longer than text i, those that the lengths, characters and runs allow."""
        total = self.size[begin:end] + self.size[i]
        matched = np.ceil(threshold * total / 2 - 1e-6).astype(np.int64)
        blocks = np.minimum(self.rare[i].sum() + 1, total - 2 * matched + 1)
        may = meet & (2 * self.size[begin:end] >= threshold * total - 1e-6)
        apart = self.n_runs[begin:end] + self.n_runs[i] - 2 * (matched - (self.q - 1) * blocks)
        may &= np.abs(self.few[:, begin:end] - self.few[:, i : i + 1]).sum(axis=0, dtype=np.int32) <= total - 2 * matched
        left = np.flatnonzero(may)
        for sketches in (self.folded.T, self.whole) if len(left) > HOT_TEXTS else (self.whole,):
            near = np.zeros(len(left), bool)
            step = max(1, (1 << 15) // sketches.shape[1])  # what a core has at hand at one time
            for k in range(0, len(left), step):
                near[k : k + step] = np.bitwise_count(sketches[begin + left[k : k + step]] ^ sketches[i]).sum(axis=1, dtype=np.int32) <= apart[left[k : k + step]]
            left = left[near]
        blocks = np.minimum(blocks[left], np.minimum(self.all[begin + left], self.rare[i]).sum(axis=1) + 1)
        return begin + left[self.overlaps(i, begin + left) >= matched[left] - (self.q - 1) * blocks]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of characters at a time."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    all_ = open_ = (1 << len(a)) - 1  # a bit falls for each character of the subsequence
    for x in b:
        hit = open_ & where.get(x, 0)
        open_ = (open_ + hit | open_ - hit) & all_
    return head + tail + len(a) - open_.bit_count()


def _alike(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters from a[i] and b[j] on are the same, ``most`` at most."""
    n = 0
    while n < most and a[i + n : i + min(n + 32, most)] == b[j + n : j + min(n + 32, most)]:
        n += 32
    n = min(n, most)
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


class Matcher:
    """difflib's matching blocks against one earlier text, found only as far as they decide whether the ratio reaches a threshold.

    difflib takes the longest stretch of characters that start blocks (all, or the rare ones of a long text), extends it and goes
    on before and behind it. Whatever follows, a stretch of x characters against one of y adds min(x, y) at most; once
    what has matched and what can still match fall short, later blocks don't count.
    """

    def __init__(self, early: str) -> None:
        self.early, self.back = early, early[::-1]
        c = points(early)
        codes, counts = np.unique(c, return_counts=True)
        start = counts <= len(early) // 100 + 1 if len(early) >= 200 else np.ones(len(codes), bool)
        self.codes, self.counts, self.first = codes[start], counts[start], (np.cumsum(counts) - counts)[start]
        self.places = np.argsort(c, kind="stable").astype(np.int32)

    def equal(self, late: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Places (of ``late``, of the earlier text) of the same character that starts blocks, in order, and how long a stretch of such ends there; None if they are too many to hold."""
        c = points(late)
        k = np.searchsorted(self.codes, c)
        starts = np.flatnonzero(np.r_[self.codes, 0][k] == c) if len(self.codes) else np.zeros(0, np.int64)
        starts = starts[k[starts] < len(self.codes)]
        n, first = self.counts[k[starts]], self.first[k[starts]]
        if n.sum() > PAIRS:
            return None
        x = np.repeat(starts.astype(np.int32), n)
        y = self.places[np.arange(len(x)) - np.repeat(np.cumsum(n) - n - first, n)]
        key = x.astype(np.int64) * (len(self.early) + 1) + y
        before = np.searchsorted(key, key - (len(self.early) + 2)).astype(np.int32)  # the place where a stretch up to here would go on from
        goes_on = np.flatnonzero(key[before] == key - (len(self.early) + 2)) if len(key) else np.zeros(0, np.int64)
        size = np.ones(len(x), np.int32)
        while len(goes_on):
            size[goes_on] += 1
            goes_on = goes_on[size[before[goes_on]] >= size[goes_on]]
        return x, y, size

    def reaches(self, late: str, threshold: float) -> bool:
        """Whether difflib's ratio of ``late`` against the earlier text is ``threshold`` or more."""
        early, total = self.early, len(self.early) + len(late)
        if not total:
            return threshold <= 1.0
        if (found := self.equal(late)) is None:
            if 2 * common_subsequence(early, late) < threshold * total - 1e-6:
                return False
            return difflib.SequenceMatcher(None, late, early).ratio() >= threshold
        x, y, ends, back = *found, late[::-1]
        bound = min(len(late), len(early))
        left = [(-bound, 0, len(late), 0, len(early))]
        while left and 2.0 * bound / total >= threshold:
            least, alo, ahi, blo, bhi = heapq.heappop(left)
            bound += least
            lo, hi = np.searchsorted(x, (alo, ahi))
            inside = lo + np.flatnonzero((y[lo:hi] >= blo) & (y[lo:hi] < bhi))
            i, j, size = alo, blo, 0
            if len(inside):
                sizes = np.minimum(ends[inside], np.minimum(x[inside] - alo, y[inside] - blo) + 1)
                best = int(sizes.argmax())
                size = int(sizes[best])
                i, j = int(x[inside[best]]) - size + 1, int(y[inside[best]]) - size + 1
            before = _alike(back, len(late) - i, self.back, len(early) - j, min(i - alo, j - blo))
            i, j, size = i - before, j - before, size + before
            size += _alike(late, i + size, early, j + size, min(ahi - i - size, bhi - j - size))
            if size:
                bound += size
                for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                    if least := min(part[1] - part[0], part[3] - part[2]):
                        bound += least
                        heapq.heappush(left, (-least, *part))
        return 2.0 * bound / total >= threshold


def close(early: str, late: str, threshold: float, matcher: Matcher | None = None) -> bool:
    """Whether the ratio of the later text against the earlier one reaches the threshold; ``matcher`` has the earlier one set."""
    return (matcher or Matcher(early)).reaches(late, threshold)


def close_pairs(texts: list[str], early_of: np.ndarray, rank: np.ndarray, meet, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs (early, late) of places whose ratio reaches the threshold.

    ``early_of``: whether a text may be the earlier one of a pair; ``rank``: the order, by length from the longest on;
    ``meet``: a function of a place and places to a mask of those that it is compared with here.
    """
    by_rank = np.argsort(rank, kind="stable")
    tile = Tile([texts[i] for i in by_rank.tolist()])
    ends = np.searchsorted(-tile.size, 1 - threshold / (2 - threshold) * tile.size, side="right")  # shorter texts are too short
    for k, i in enumerate(by_rank.tolist()):
        if not early_of[i] or ends[k] <= k + 1:
            continue
        late = tile.candidates(k, k + 1, int(ends[k]), meet(i, by_rank[k + 1 : ends[k]]), threshold)
        if len(late):
            m = Matcher(texts[i])
            yield from ((i, j) for j in by_rank[late].tolist() if close(texts[i], texts[j], threshold, m))
