"""Near copies: SimHash classes, completed by texts whose word shingles have a Jaccard similarity of 0.8 or more.

At a similarity of 0.8 two fingerprints of 64 bits differ in about ten bits, and no pigeonring of that budget leaves
keys selective enough for a large corpus. So the links of the SimHash operator come first, and what lies beyond its
three bits is found by MinHash: a sketch holds one byte of each of 320 minima, the first 160 in 32 bands of five, and
texts that agree on a band are candidates. Two texts of similarity 0.8 share no band with a chance of less than
(1 - 0.8 ** 5) ** 32, about 3 in a million. Candidates are verified on the shingles themselves.

Large groups of copies do not give all their pairs. A first pass verifies only a spanning forest of the likely links of
each band; a second one takes the pairs of a band that are still in different groups, each in the first band it shares,
unless their sketches agree on so little (an estimate below 0.71, four deviations from 0.8) that a pair at exactly 0.8
would be lost with a chance of 3 in 100,000. Bands of many texts are dealt in blocks to tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import cut, kept, partitions_of, text_or_empty, unused
from tidelex.llm.components import components
from tidelex.llm.simhash import SEED, near_duplicates

WORDS, BANDS, ROWS = 5, 32, 5
#: Minima of a sketch; the bands take the first of them, all make the estimate.
MINIMA = 2 * BANDS * ROWS
SIMILARITY, LEAST_ESTIMATE = 0.8, 0.71
#: Rows of a block of a large band; bands of up to twice as many texts are compared in one task.
TILE_ROWS = 1024
U = np.uint64
_DRAW = np.random.default_rng(SEED)
_TIMES = _DRAW.integers(0, 1 << 63, MINIMA, U) * U(2) + U(1)
_PLUS = _DRAW.integers(0, 1 << 63, MINIMA, U) * U(2)


def shingles(text: str, words: int = WORDS) -> set[bytes]:
    """The text's runs of ``words`` words, or all its words where it has fewer; none of a blank text."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def minima(found: set[bytes]) -> np.ndarray:
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), dtype=U, count=len(found))
    least = np.full(MINIMA, ~U(0))
    for at in range(0, len(h), 2048):
        np.minimum(least, (h[None, at : at + 2048] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return least


def sketch(least: np.ndarray) -> bytes:
    """One byte of each minimum; not the top one, which is 0 in most minima of many shingles."""
    return (least >> U(24) & U(255)).astype(np.uint8).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of rows of sketches; agreement by chance, one in 256, is taken off."""
    return ((a == b).mean(axis=1) - 1 / 256) * 256 / 255


def sketches_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """node long, size int (distinct shingles), sketch binary. Blank texts and null ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, sketches = [], [], []
            for node, text in zip(b["node"].to_pylist(), b["text"].to_pylist(), strict=True):
                if found := shingles(text, words):
                    nodes.append(node)
                    sizes.append(len(found))
                    sketches.append(sketch(minima(found)))
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "size": pa.array(sizes, pa.int32()), "sketch": pa.array(sketches, pa.binary())})

    return texts_of(docs).mapInArrow(run, "node long, size int, sketch binary")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), text_or_empty().alias("text"))


def shared_bands(nodes: DataFrame) -> DataFrame:
    """key, n, band, node, size, sketch: a row for each band that a text shares with another, with the band's number of texts."""
    bands = nodes.select("node", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    keyed = bands.select(F.xxhash64("band", F.substring("sketch", F.col("band") * ROWS + 1, F.lit(ROWS))).alias("key"), F.col("band").cast("byte").alias("band"), "node")
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(counted, "key").join(nodes, "node").select("key", "n", "band", "node", "size", "sketch")


def _sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) >= SIMILARITY * np.maximum(a, b) - 1e-9


def _columns(b: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})


def tile_pairs(key: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray, block: np.ndarray, whole: np.ndarray, band: np.ndarray, sketches: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and estimates of pairs of equal key and different group (and different block unless ``whole``) that sizes and sketches allow.

    A pair counts in the first band that its sketches share only.
    """
    none = np.zeros(0, np.int64)
    found_a, found_b, about, at, lag = [none], [none], [np.zeros(0)], np.arange(len(key)), 1
    while len(at):
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        hit = at[(group[at] != group[at + lag]) & ((block[at] != block[at + lag]) | (whole[at] == 1)) & _sizes_allow(size[at], size[at + lag])]
        if len(hit):
            likely = estimate(sketches[hit], sketches[hit + lag])
            hit, likely = hit[likely >= least], likely[likely >= least]
            shared = (sketches[hit, : BANDS * ROWS] == sketches[hit + lag, : BANDS * ROWS]).reshape(len(hit), BANDS, ROWS).all(axis=2)
            first = shared.any(axis=1) & (shared.argmax(axis=1) == band[hit])
            found_a.append(hit[first])
            found_b.append(hit[first] + lag)
            about.append(likely[first])
        lag += 1
    return np.concatenate(found_a), np.concatenate(found_b), np.concatenate(about)


def spanning(group_a: np.ndarray, group_b: np.ndarray, about: np.ndarray) -> np.ndarray:
    """Which pairs join groups that likelier pairs have not joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    kept = []
    for i in np.argsort(-about, kind="stable").tolist():
        x, y = top(int(group_a[i])), top(int(group_b[i]))
        if x != y:
            up[x] = y
            kept.append(i)
    return np.array(kept, np.int64)


def band_pairs(members: DataFrame, partitions: int, forest: bool) -> DataFrame:
    """u, v: pairs of a band whose groups differ and whose sketches may belong to texts of similarity 0.8.

    All of them, or of the likely ones a spanning ``forest`` of each task's groups.
    """
    names = ("tile", "node", "group", "size", "block", "whole", "band")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []

        def made(upto: int | None) -> pa.RecordBatch:
            columns = [np.concatenate([h[0][i] for h in held]) for i in range(len(names))]
            sketches = np.concatenate([h[1] for h in held])
            held[:] = [([x[upto:] for x in columns], sketches[upto:])] if upto is not None else []
            columns = [x[:upto] for x in columns]
            a, b, about = tile_pairs(*columns, sketches[:upto], SIMILARITY if forest else LEAST_ESTIMATE)
            node, group = columns[1], columns[2]
            keep = spanning(group[a], group[b], about) if forest else slice(None)
            return _pairs(node[a[keep]], node[b[keep]])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((_columns(b, names), np.frombuffer(b"".join(b["sketch"].to_pylist()), np.uint8).reshape(-1, MINIMA)))
            tile = held[-1][0][0]
            if tile[0] != tile[-1] and sum(len(h[1]) for h in held) >= 50_000:
                yield made(sum(len(h[1]) for h in held) - int((tile == tile[-1]).sum()))  # the last tile may go on in the next batch
        if held:
            yield made(None)

    mixed = members.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
    blocks = F.ceil(F.col("n") / TILE_ROWS).cast("int")
    mine = F.when(F.col("n") <= 2 * TILE_ROWS, 0).otherwise(F.pmod(F.xxhash64("node"), blocks)).cast("int")
    across = F.when(F.col("n") <= 2 * TILE_ROWS, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))
    rows = members.join(mixed, "key").withColumn("block", mine).withColumn("other", F.explode(across))
    rows = rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "node", "group", "size", "block", (F.col("block") == F.col("other")).cast("int").alias("whole"), "band", "sketch")
    return rows.repartition(partitions, "tile").sortWithinPartitions("tile").mapInArrow(pair, "u long, v long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs whose texts (node, text) have a shingle similarity of 0.8 or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, set()
        for b in batches:
            keep = []
            for s, t in zip(b["s"].to_pylist(), b["t"].to_pylist(), strict=True):
                if t != last:
                    last, y = t, shingles(t, words)
                x = shingles(s, words)
                common = len(x & y)
                keep.append(common >= SIMILARITY * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_pydict({"u": b["u"], "v": b["v"]}).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("s")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("t")), "v")
    return both.mapInArrow(check, "u long, v long")


def simhash_links(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """u, v: documents whose fingerprints over shingles of ``words`` words the SimHash operator puts in one class."""
    found = near_duplicates(docs, words).where("doc_id <> component_id")
    return found.select(F.col("component_id").alias("u"), F.col("doc_id").alias("v")).distinct()


def copy_components(docs: DataFrame, words: int = WORDS, start: DataFrame | None = None) -> DataFrame:
    """node, component: documents joined by chains of similarity 0.8 or more and of the links ``start`` (u, v), and the smallest doc_id of each chain.

    Documents without such a copy give no row.
    """
    partitions = max(partitions_of(docs), 8)
    members = kept(shared_bands(kept(sketches_of(docs, words), "sketches")), "bands")
    texts = kept(texts_of(docs).join(members.select("node").distinct(), "node", "left_semi"), "texts")
    links = start if start is not None else docs.sparkSession.createDataFrame([], "u long, v long")
    for forest in (True, False):
        links = cut(links)
        grouped = kept(members.join(components(links), "node", "left").select(*members.columns, F.coalesce("component", "node").alias("group")), "groups")
        links = links.unionByName(verified(cut(band_pairs(grouped, partitions, forest)), texts, words))
    return components(links)


def drop_near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its chain of near copies, and all others without a near copy.

    A near copy is one by SimHash (three bits) or by a similarity of 0.8 or more, both over shingles of five words.
    Null and blank texts are copies of each other; rows without a doc_id stay; rows that repeat a doc_id stay or go
    together. An empty table gives no rows. Other columns, whatever their names, are kept as they are.
    """
    (id_,) = unused(docs, "__id")
    gone = copy_components(docs, words, simhash_links(docs, words)).where("node <> component").select(F.col("node").alias(id_)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(id_), "left_anti")
