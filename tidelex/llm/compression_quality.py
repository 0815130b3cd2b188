"""Compression classifier of text quality.

Two Zstandard dictionaries are trained, one on pieces of good and one on pieces of bad labelled texts. A text is cut
into pieces of a few hundred bytes, so that what it holds itself can't stand in for a dictionary, and every piece is
compressed with either. The difference of the summed sizes, per byte of text, is what the classifier knows of a text;
a logistic curve fitted to labelled texts that made no dictionary turns it into a score.

Dictionaries and curve come from a bounded sample of labelled rows (``sample_rows``); all rows are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import cut, first_rows, text_or_empty, unused

PIECE_BYTES, DICT_BYTES, LEVEL = 512, 1 << 18, 3
#: Bytes added to a text's length, which draw the differences of very short texts to 0.
SHRINK = 32
#: Of the sampled rows, the share (one in so many) that fits the curve and makes no dictionary.
CURVE = 3


def pieces(text: str, size: int = PIECE_BYTES) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + size] for i in range(0, len(data), size)]


def chosen_pieces(text: str, most: int) -> list[bytes]:
    """At most ``most`` pieces from anywhere in the text, by a hash of what they hold."""
    return sorted(pieces(text), key=lambda p: (xxhash.xxh3_64_intdigest(p), p))[:most]


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary of the samples; where they are too few to train on, the samples themselves, one after the other."""
    samples = sorted(samples)
    held = sum(map(len, samples))
    if held > 16 * PIECE_BYTES:
        try:
            return zstandard.train_dictionary(min(size, max(1024, held // 8)), samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few or too much alike
            pass
    return b"".join(samples)[-size:]


@dataclass
class CompressionModel:
    """Dictionaries of good and bad texts, and the curve from the size difference to a score."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    bias: float = 0.0

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in (self.bad, self.good):
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def differ(self):
        """A function from text to (size with the bad dictionary - size with the good one) / (bytes + SHRINK); an empty text gives 0."""
        if not (self.good and self.bad):
            return lambda text: 0.0
        bad, good = self._compressors()

        def difference(text: str) -> float:
            cut_up = pieces(text)
            n = sum(len(bad.compress(p)) - len(good.compress(p)) for p in cut_up)
            return n / (sum(map(len, cut_up)) + SHRINK)

        return difference

    def score(self, difference):
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * difference + self.bias, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 60) -> tuple[float, float]:
    """Slope and bias of the logistic curve by damped Newton steps on the mean log loss plus ``ridge`` times the squared slope in units of x's spread."""
    unit = float(x.std()) or 1.0
    z, w, b = x / unit, 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    loss = lambda w, b: float(np.mean(np.logaddexp(0, -(2 * y - 1) * (w * z + b)))) + ridge * w * w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(w * z + b)))
        g = np.array([np.mean((p - y) * z) + 2 * ridge * w, np.mean(p - y)])
        v = p * (1 - p)
        h = np.array([[np.mean(v * z * z) + 2 * ridge, np.mean(v * z)], [np.mean(v * z), np.mean(v)]]) + 1e-9 * np.eye(2)
        step, rate, now = np.linalg.solve(h, g), 1.0, loss(w, b)
        while rate > 1e-6 and loss(w - rate * step[0], b - rate * step[1]) > now:
            rate /= 2
        w, b = w - rate * step[0], b - rate * step[1]
        if np.abs(g).max() < 1e-10:
            break
    return float(w / unit), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, sample_rows: int = 6_000, repeats: int = 4) -> DataFrame:
    """doc_id, text, y of at most ``sample_rows`` labelled ids for which ``train`` (a condition on doc_id) holds, by a hash of the id.

    The ids and labels chosen (under 16 bytes a row) are broadcast to the documents. Of rows that repeat a doc_id the
    ``repeats`` first by text are taken, so the sample has a bound in rows; of a doc_id with several labels the largest
    counts. Rows without doc_id or label are left out. Empty tables give an empty sample.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.lit(True) if train is None else train))
    chosen = usable.groupBy("doc_id").agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    chosen = cut(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return first_rows(rows, "doc_id", ["text"], repeats)


def fit(sample: DataFrame, pieces_a_text: int = 8, parts: int = 16) -> CompressionModel:
    """Dictionaries from two thirds of the sample (``pieces_a_text`` pieces of each text come to the driver), the curve from the other third.

    Where a class is missing among the texts for dictionaries or those for the curve, every score is the sample's base
    rate.
    """
    rows = cut(sample.select("text", "y", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(CURVE)) == 0).alias("curve")).repartition(parts))
    known = {(r.curve, r.y): r.n for r in rows.groupBy("curve", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    good = sum(n for (_, y), n in known.items() if y == 1)
    base = CompressionModel(bias=float(np.log((good + 0.5) / (sum(known.values()) - good + 0.5))))
    if len(known) < 4:
        return base

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"y": b["y"], "held": pa.array([chosen_pieces(t, pieces_a_text) for t in b["text"].to_pylist()], pa.list_(pa.binary()))})

    held: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.where("not curve").select("text", "y").mapInArrow(cut_up, "y int, held array<binary>").toLocalIterator():
        held[r.y] += map(bytes, r.held)
    if not (any(held[0]) and any(held[1])):
        return base
    model = CompressionModel(dictionary(held[1]), dictionary(held[0]))
    found = differences(rows.where("curve").select("y", "text"), model, "x").select("x", "y").collect()
    model.slope, model.bias = fit_curve(np.array([r.x for r in found]), np.array([r.y for r in found], float))
    return model


def differences(docs: DataFrame, model: CompressionModel, name: str) -> DataFrame:
    """The frame with the size difference of each row's whole text in a new column."""
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        difference = CompressionModel(*shared.value).differ()
        for texts in parts:
            yield pd.Series([difference(t) for t in texts], dtype="float64")

    return docs.withColumn(name, F.pandas_udf(run, "double")(text_or_empty()))


def score(docs: DataFrame, model: CompressionModel, keep: str | None = None) -> DataFrame:
    """doc_id, difference, score of every row, or all columns of ``docs`` and the score in a new column named ``keep``.

    A null text counts as empty; an empty text's score is the curve's value at 0. Texts of any length are compressed
    whole, piece by piece. Repeated rows give repeated rows, a null doc_id stays null, an empty table gives no rows. Without ``keep`` other
    columns are not read; with it the caller picks a name that ``docs`` does not have (``common.unused``).
    """
    (at,) = unused(docs, "difference")
    rows = differences(docs if keep else docs.select("doc_id", "text"), model, at)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(at) * model.slope + model.bias))
    value = 1.0 / (1.0 + F.exp(-z))
    return rows.withColumn(keep, value).drop(at) if keep else rows.select("doc_id", F.col(at).alias("difference"), value.alias("score"))
