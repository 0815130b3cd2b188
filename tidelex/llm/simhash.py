"""Near-duplicates by SimHash, with candidates filtered by the pigeonring principle.

A fingerprint is cut into a ring of four 16-bit segments. If two fingerprints differ in at most t = 3 bits, the
pigeonring principle gives a segment from which every chain of consecutive segments stays within its share of the
budget: l segments hold at most floor(l * t / 4) differences, so the first is equal. The 48 bits behind that segment
form a second ring of four 12-bit boxes with the same budget, and so again a chain that starts with an equal box.
Fingerprints therefore meet under 16 keys of 28 equal bits, and a pair goes on to the full Hamming check only while
both chains stay within budget. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import cut, partitions_of, text_or_empty, unused
from tidelex.llm.components import components

SEED = 42
BITS = 3
#: Up to this size a bucket's pairs are compared all at once, a larger one is searched for its links breadth first.
SMALL_BUCKET = 48
U = np.uint64


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash over the XXH64 (seed 42) of every ``words``-word shingle, repeats included; 0 without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return digest(b" ".join(w), SEED)
    join = b" ".join
    n = len(w) - words + 1
    h = np.fromiter((digest(join(t), SEED) for t in zip(*[w[i:] for i in range(words)], strict=False)), dtype=">u8", count=n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp long (the fingerprint's bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in b["text"].to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "fp": pa.array(fp.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ring(fp: np.ndarray, i: int) -> np.ndarray:
    """The fingerprint turned so that segment i stands in front."""
    left = U(16 * i)
    return fp if i == 0 else (fp << left) | (fp >> U(64 - 16 * i))


def _inner(turned: np.ndarray, j: int) -> np.ndarray:
    """The 48 bits behind the first segment, turned so that their box j stands in front."""
    rest = turned & U(0xFFFFFFFFFFFF)
    return rest if j == 0 else ((rest << U(12 * j)) | (rest >> U(48 - 12 * j))) & U(0xFFFFFFFFFFFF)


def ring_keys(fp: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(4):
        turned = _ring(fp, i)
        for j in range(4):
            yield (U(i * 4 + j) << U(28)) | (turned >> U(48) << U(12)) | (_inner(turned, j) >> U(36))


def viable(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs of a bucket (start = 4 i + j) pass both chains and the full check."""
    x, ok = a ^ b, np.arange(len(a))
    count = np.bitwise_count
    turned = np.empty_like(x)
    rest = np.empty_like(x)
    for s in range(16):
        if (m := start == s).any():
            turned[m] = _ring(x[m], s // 4)
            rest[m] = _inner(turned[m], s % 4)
    for ring, size, total in ((turned, 16, 64), (rest, 12, 48)):
        for length in (2, 3):
            keep = count(ring[ok] >> U(total - size * length)) <= length * BITS // 4
            ok = ok[keep]
    ok = ok[count(x[ok]) <= BITS]
    out = np.zeros(len(a), bool)
    out[ok] = True
    return out


def bucket_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within buckets of equal keys (sorted): all of small ones, of larger ones a forest that joins the same nodes."""
    found = []
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    sizes = np.diff(edges)
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    start = (key >> U(28)).astype(np.int64)
    k, f, n, st = key[small], fp[small], node[small], start[small]
    lag = 1
    while lag < len(k):
        same = np.flatnonzero(k[lag:] == k[:-lag])
        if not len(same):
            break
        hit = same[viable(f[same], f[same + lag], st[same])]
        found.append((n[hit], n[hit + lag]))
        lag += 1
    for at, size in zip(edges[:-1][sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        f, n, s = fp[at : at + size], node[at : at + size], start[at]
        left = np.arange(size)
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                me = todo.pop()
                hit = viable(np.full(len(left), f[me]), f[left], np.full(len(left), s))
                near, left = left[hit], left[~hit]
                found.append((n[near], np.full(len(near), n[me])))
                todo.extend(near)
    return found


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Each node of the pairs and the least node it is joined to."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = [x for x in up if top(x) != x]
    return nodes, [top(x) for x in nodes]


def near_links(nodes: DataFrame, partitions: int) -> DataFrame:
    """u, v: links between distinct fingerprints (fp long, node long) that join all within 3 bits of each other."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for key in ring_keys(fp):
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "fp": b["fp"], "node": b["node"]})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made(rows: np.ndarray) -> pa.RecordBatch:
            u, v = _forest(bucket_links(rows[0].view(np.uint64), rows[1].view(np.uint64), rows[2]))
            return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([b[c].to_numpy() for c in ("key", "fp", "node")]))
            last = held[-1][0, -1]
            if held[-1][0, 0] != last and sum(x.shape[1] for x in held) >= 200_000:
                rows = np.concatenate(held, axis=1)
                open_at = int(np.searchsorted(rows[0], last))  # the last bucket may go on in the next batch
                held = [rows[:, open_at:]]
                yield made(np.ascontiguousarray(rows[:, :open_at]))
        if held:
            yield made(np.ascontiguousarray(np.concatenate(held, axis=1)))

    keyed = nodes.select("fp", "node").mapInArrow(keys, "key long, fp long, node long")
    return keyed.repartition(partitions, "key").sortWithinPartitions("key", "fp").mapInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp long, component_id: documents joined by chains of fingerprints that differ in at most 3 bits.

    component_id is the smallest doc_id reachable, itself included. A null or blank text has fingerprint 0 and is
    linked like any other. Repeated rows give repeated rows. Rows without a doc_id link nothing and get a null
    component. An empty table gives no rows. Very long texts are shingled whole. Only doc_id and text are read, so other
    columns may have any names.
    """
    partitions = partitions_of(docs)
    fps = cut(fingerprints(docs, words))
    nodes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    joined = components(near_links(nodes, max(partitions, 8)))
    labels = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(labels, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, and rows without a doc_id."""
    (id_,) = unused(docs, "__id")
    gone = near_duplicates(docs, words).where("doc_id <> component_id").select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(id_), "left_anti")
