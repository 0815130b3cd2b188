"""Mixing documents to target domain weights by soft membership.

A classifier learned from a labelled table predicts each document's domain posteriors. Nonnegative rates are then
fitted so that the expected tokens of each domain, sum of rate * tokens * posterior, match the targets: projected
gradient steps on the least squares error, weighted by the inverse of the domains' token Gram matrix, for which a
step of 1 is exact where no rate is at 0. A document's rate follows from its tokens, its posteriors and the history
of residuals, so a step is one pass that sums a vector per domain, and no rates are kept between the steps.
"""

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import cut, first_rows, text_or_empty, unused

SLOTS = 1 << 11
CACHE_ROWS = 400_000
#: Targets missed by more than this share of all tokens are warned of.
WARN_RESIDUAL = 0.01


def _features(text: str, cache: dict[str, int]) -> np.ndarray:
    """Root-scaled shares of hashed lower-case words; unit length unless the text has none."""
    words = text.lower().split()
    if len(cache) > CACHE_ROWS:
        cache.clear()
    at = [cache[w] if w in cache else cache.setdefault(w, zlib.crc32(w.encode("utf-8", "surrogatepass")) % SLOTS) for w in words]
    return np.sqrt(np.bincount(at, minlength=SLOTS) / max(1, len(words))).astype(np.float32)


def fit_posteriors(labelled: DataFrame, domains: list[str], steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on (text, domain) rows, which the caller has bounded. Returns weights and biases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            rows = [_features(t, cache) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": b["y"], "slot": pa.array([np.flatnonzero(r).astype(np.int32).tobytes() for r in rows], pa.binary()), "value": pa.array([r[r > 0].tobytes() for r in rows], pa.binary())})

    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int") - 1
    rows = labelled.select(text_or_empty().alias("text"), place.alias("y")).where("y >= 0").mapInArrow(run, "y int, slot binary, value binary").collect()  # bytes: lists would be Python objects, some twenty times as large
    x, y = np.zeros((len(rows), SLOTS), np.float32), np.zeros((len(rows), len(domains)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.slot, np.int32)] = np.frombuffer(r.value, np.float32)
        y[i, r.y] = 1
    w, b = np.zeros((SLOTS, len(domains)), np.float32), np.zeros(len(domains), np.float32)
    for _ in range(steps if len(rows) else 0):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = p / p.sum(axis=1, keepdims=True) - y
        w -= 4.0 * (x.T @ g / len(rows) + l2 * w)
        b -= 1.0 * g.mean(axis=0)
    return w, b


def labelled_sample(docs: DataFrame, labels: DataFrame, domain_col: str, sample_rows: int = 5000, repeats: int = 4) -> DataFrame:
    """(text, domain) of at most ``sample_rows`` ids of the labelled table, by a hash of the id; the ids are broadcast.

    Of rows that repeat a doc_id the ``repeats`` first by domain and text are taken, so the sample has a bound in rows.
    """
    ids = labels.where("doc_id is not null").select("doc_id").distinct()
    chosen = cut(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select("doc_id", "text", F.col(domain_col).alias("domain")).where("domain is not null").join(F.broadcast(chosen), "doc_id")
    return first_rows(rows, "doc_id", ["domain", "text"], repeats).select("text", "domain")


def posteriors(docs: DataFrame, weights: np.ndarray, biases: np.ndarray) -> DataFrame:
    """doc_id, n_tokens (white-space words), posterior array<double> of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, biases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, b), cache = shared.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part["text"].to_pylist()
                z = (np.stack([_features(t, cache) for t in texts]) @ w + b).astype(np.float64)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "n_tokens": pa.array([len(t.split()) for t in texts], pa.int64()), "posterior": pa.array(list(p), pa.list_(pa.float64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def _summed(frame: DataFrame, fn, size: int) -> np.ndarray:
    """The sum over all rows of fn(n_tokens, posterior), a vector: one partial vector per task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += fn(b["n_tokens"].to_numpy().astype(np.float64), np.stack(b["posterior"].to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "x": total})

    out = np.zeros(size)
    for row in frame.select("n_tokens", "posterior").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[row.i] = row.x
    return out


def replay(posterior: np.ndarray, history: np.ndarray, most: float = np.inf) -> np.ndarray:
    """Rates, from 0 to ``most``, after the steps of ``history`` (one scaled residual vector each), from 1 at the start."""
    rate = np.ones(len(posterior))
    for step in history:
        rate = np.clip(rate - posterior @ step, 0.0, most)
    return rate


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain_col: str = "lang", total_tokens: float | None = None, sample_rows: int = 5000, steps: int = 40, tolerance: float = 1e-4, seed: int = 7, max_rate: float = np.inf) -> DataFrame:
    """doc_id, n_tokens, posterior, rate, copies, residual of every row.

    ``targets``: domain to weight, scaled to add up to 1 of ``total_tokens`` (by default all tokens there are).
    ``max_rate`` bounds the rates in every projection, for targets that the documents can only meet by many copies.
    ``copies`` is the rate rounded up or down by a hash of the id, so that its expectation is the rate. A text
    without words has 0 tokens and the rate that its posteriors give; a very long one is read whole. Labelled rows of a null domain or one that
    is not among the targets teach nothing. Repeated rows are documents each. With no documents there are no rows.
    Columns beside doc_id, text and ``domain_col`` are not read. ``residual`` is the same on every row: the largest
    distance of a domain's expected tokens from its target, as a share of ``total_tokens``. It exceeds ``tolerance``
    only where ``steps`` steps did not meet the targets, as when ``max_rate`` puts them out of reach; beyond one per
    cent a warning says so.
    """
    if not targets or min(targets.values()) < 0 or not sum(targets.values()) > 0:
        raise ValueError("targets need nonnegative weights, one of them positive")
    domains = sorted(targets)
    k = len(domains)
    weights, biases = fit_posteriors(labelled_sample(docs, labels, domain_col, sample_rows), domains)
    soft = cut(posteriors(docs, weights, biases))
    stats = _summed(soft, lambda n, p: np.r_[(p * n[:, None]).T @ p, (p * n[:, None]).sum(axis=0)[None, :]].reshape(-1), k * k + k)
    gram, have = stats[: k * k].reshape(k, k), stats[k * k :]
    total = have.sum() if total_tokens is None else total_tokens
    want = np.array([targets[d] for d in domains]) / sum(targets.values()) * total
    inverse = np.linalg.pinv(gram, rcond=1e-9)
    history, now = np.zeros((0, k)), have
    while len(history) < steps and np.abs(now - want).max() > tolerance * max(total, 1.0):
        history = np.r_[history, (inverse @ (now - want))[None, :]]
        now = _summed(soft, lambda n, p, h=history: (replay(p, h, max_rate) * n) @ p, k)

    def rates(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(replay(np.stack(p.to_numpy()), history, max_rate) if len(p) else [], dtype="float64")

    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    rated = soft.withColumn("rate", F.pandas_udf(rates, "double")("posterior"))
    residual = float(np.abs(now - want).max() / max(total, 1.0))
    if residual > max(WARN_RESIDUAL, tolerance):
        warnings.warn(f"a domain's expected tokens miss their target by {residual:.1%} of all tokens", stacklevel=2)
    return rated.withColumn("copies", (F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("int")).cast("int")).withColumn("residual", F.lit(residual))


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say; rows of one doc_id share the least of their numbers."""
    id_, n, one = unused(docs, "__id", "__copies", "__copy")
    copies = mixing_rates(docs, labels, targets, **options).groupBy("doc_id").agg(F.min("copies").alias(n)).withColumnRenamed("doc_id", id_)
    joined = docs.join(copies, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    return joined.where(F.col(n) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(one)).drop(one)
