"""Counterfactually regularised toxicity classifier.

A linear model over words and their beginnings is fitted to labelled texts. Every labelled text that names a group
is also read with the term swapped for others of the same list, and the fit penalises the squared change of the
score, so the mention of a group moves the score little whatever words it comes with.

The fit uses a bounded sample of labelled rows (``sample_rows``, chosen by a hash of the id). Scoring covers all rows.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import cut, first_rows, text_or_empty

WORD = re.compile(r"[^\W_]+")
#: Default identity terms; any mention of one may be swapped for any other of its list. Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("old", "young"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)
SLOTS = 1 << 20
CACHE_ROWS = 400_000


def features(word: str) -> list[int]:
    """Hashed slots of a lower-case word: itself and its beginnings of 3 to 7 letters."""
    own = [zlib.crc32(b"=" + word.encode("utf-8", "surrogatepass")) % SLOTS]
    return own + [zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) % SLOTS for n in range(3, min(7, len(word)) + 1)]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swapped(words: set[str], terms: tuple[tuple[str, ...], ...]) -> list[set[str]]:
    """The word set with each identity term it holds replaced by the other terms of its list, one at a time."""
    out = []
    for group in terms:
        for term in words.intersection(group):
            out += [(words - {term}) | {other} for other in group if other != term]
    return out


@dataclass
class ToxicityModel:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def scorer(self):
        """A function from text to score that remembers the weights of words it has met."""
        known: dict[str, float] = {}

        def score(text: str) -> float:
            words = words_of(text)
            if len(known) > CACHE_ROWS:
                known.clear()
            for w in words.difference(known):
                known[w] = self.word_weight(w)
            z = self.bias + sum(sorted(map(known.__getitem__, words)))
            return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))

        return score


@dataclass
class Packed:
    """Rows of (slot, value) entries in three flat buffers; a Counter a row took some twenty times their size."""

    lengths: list[int] = field(default_factory=list)
    slots: bytearray = field(default_factory=bytearray)
    values: bytearray = field(default_factory=bytearray)

    def add(self, slots: bytes, values: bytes) -> None:
        """One more row, of 32-bit integers."""
        self.lengths.append(len(slots) // 4)
        self.slots += slots
        self.values += values

    def __len__(self) -> int:
        return len(self.lengths)


def _rows(matrix: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.repeat(np.arange(len(matrix)), np.array(matrix.lengths, np.int64))
    return at, np.frombuffer(matrix.slots, np.int32).astype(np.int64), np.frombuffer(matrix.values, np.int32).astype(np.float64)


def fit_weights(rows: Packed, labels: np.ndarray, changes: Packed, size: int, swap_penalty: float, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 and L2 term and ``swap_penalty`` times the mean squared change under swaps, by accelerated proximal gradient steps."""
    at, slot, value = _rows(rows)
    c_at, c_slot, c_value = _rows(changes)
    n, m = max(1, len(rows)), max(1, len(changes))
    norm = np.bincount(at, weights=value * value, minlength=n) if len(at) else np.zeros(n)
    c_norm = np.bincount(c_at, weights=c_value * c_value, minlength=m) if len(c_at) else np.zeros(m)
    column = np.bincount(slot, weights=value * value, minlength=size) if len(slot) else np.zeros(size)
    # an upper bound of the curvature: mean row norm times the largest column's share
    bound = 0.25 * min(norm.max(initial=0) + 1, np.sqrt(max(column.sum(), 1.0) * (column.max(initial=0) + n)) / n + 1) + swap_penalty * c_norm.max(initial=0) + l2
    w, b = np.zeros(size), 0.0
    y_w, y_b, t = w, b, 1.0
    for _ in range(steps):
        z = np.bincount(at, weights=y_w[slot] * value, minlength=n) + y_b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.bincount(slot, weights=g[at] * value, minlength=size) / n + l2 * y_w
        if len(c_at):
            d = np.bincount(c_at, weights=y_w[c_slot] * c_value, minlength=m)
            grad += swap_penalty * np.bincount(c_slot, weights=d[c_at] * c_value, minlength=size) / m
        new = y_w - grad / bound
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / bound, 0)
        new_b = y_b - g.mean() / bound if len(labels) else 0.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y_w, y_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


def fit(labelled: DataFrame, identity_terms=IDENTITY_TERMS, slots: int = 4096, swap_penalty: float = 4.0, l1: float = 2e-4, l2: float = 1e-5, steps: int = 400, parts: int = 16) -> ToxicityModel:
    """Fit to (text, toxic) rows, which the caller has bounded.

    Two passes: the first counts hashed features by label, adds them up over all tasks and keeps the ``slots`` with the strongest association,
    the second brings the rows' counts of these to the driver. Null labels are left out, a null text is empty.
    """
    rows = cut(labelled.where("toxic is not null").select(text_or_empty().alias("text"), F.col("toxic").cast("int").alias("toxic")).repartition(parts))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SLOTS), np.int32)
        cache: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                slots_of: set[int] = set()
                for w in words_of(text):
                    slots_of.update(cache.get(w) or cache.setdefault(w, features(w)))
                if len(cache) > CACHE_ROWS:
                    cache.clear()
                seen[int(toxic == 1), list(slots_of)] += 1
        used = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_pydict({"slot": used.astype(np.int32), "c0": seen[0, used], "c1": seen[1, used]})

    known = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    if not 0 < known.toxic < known.n:  # nothing to tell apart: the base rate is the score
        rate = (known.toxic + 0.5) / (known.n + 1)
        return ToxicityModel({}, float(np.log(rate / (1 - rate))))
    share, both = known.toxic / known.n, F.col("c0") + F.col("c1")
    spread = F.sqrt(both * share * (1 - share) * F.greatest(1 - both / known.n, F.lit(1e-9)) + 0.5)
    counts = rows.mapInArrow(screen, "slot int, c0 int, c1 int").groupBy("slot").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where(both > 1)
    strongest = counts.orderBy(F.desc(F.abs(F.col("c1") - both * share) / spread), "slot").limit(slots)
    kept = np.sort(np.array([r.slot for r in strongest.select("slot").collect()], np.int64))
    at_slot = {int(s): i for i, s in enumerate(kept)}

    def count(words: set[str], cache: dict[str, list[int]]) -> Counter:
        out: Counter = Counter()
        for w in words:
            found = cache.get(w)
            if found is None:
                found = cache[w] = [at_slot[f] for f in features(w) if f in at_slot]
            out.update(found)
        return out

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for b in batches:
            kind, label, slot, value = [], [], [], []
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                words = words_of(text)
                own = count(words, cache)
                changed = [Counter({k: v for k, v in (own - c).items()} | {k: -v for k, v in (c - own).items()}) for c in (count(s, cache) for s in swapped(words, identity_terms))]
                for k, c in ((0, own), *((1, c) for c in changed if c)):
                    kind.append(k)
                    label.append(int(toxic == 1))
                    slot.append(np.fromiter(c.keys(), np.int32, len(c)).tobytes())
                    value.append(np.fromiter(c.values(), np.int32, len(c)).tobytes())
                if len(cache) > CACHE_ROWS:
                    cache.clear()
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "label": pa.array(label, pa.int32()), "slot": pa.array(slot, pa.binary()), "value": pa.array(value, pa.binary())})

    texts, changes, labels = Packed(), Packed(), []
    for row in rows.mapInArrow(reduce_rows, "kind int, label int, slot binary, value binary").toLocalIterator():
        (changes if row.kind else texts).add(row.slot, row.value)
        if not row.kind:
            labels.append(row.label)
    w, b = fit_weights(texts, np.asarray(labels, dtype=np.float64), changes, len(kept), swap_penalty, l1, l2, steps)
    return ToxicityModel({int(kept[i]): float(w[i]) for i in np.flatnonzero(w)}, float(b))


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, folds: int = 5, held_out_fold: int = 0, repeats: int = 4) -> DataFrame:
    """(text, toxic) of at most ``sample_rows`` labelled ids outside the held-out fold, by a hash of the id.

    The sample's ids and labels (16 bytes a row, so under half a megabyte) are broadcast to the documents.
    Of rows that repeat a doc_id the ``repeats`` first by text are taken, so the sample has a bound in rows; of a doc_id
    with several labels the largest counts. Empty tables give an empty sample.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != held_out_fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = cut(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return first_rows(rows, "doc_id", ["text"], repeats).select("text", "toxic")


def score(docs: DataFrame, model: ToxicityModel, keep: str | None = None) -> DataFrame:
    """doc_id, score of every row, or all columns of ``docs`` and the score in a new column named ``keep``.

    A null text counts as empty; an empty text's score is the model's bias alone. Repeated rows give repeated rows.
    Very long texts are scored whole. An empty table gives no rows. Without ``keep`` other columns are not read; with it
    the caller picks a name that ``docs`` does not have (``common.unused``).
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:  # the words met so far serve all batches of a task
        fn = ToxicityModel(*shared.value).scorer()
        for text in parts:
            yield pd.Series([fn(t) for t in text], dtype="float64")

    value = F.pandas_udf(scores, "double")(text_or_empty())
    return docs.withColumn(keep, value) if keep else docs.select("doc_id", value.alias("score"))
