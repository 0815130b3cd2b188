"""Word hashing in blocks, and compact columns of sorted keys.

Corpus-wide questions about short word sequences (how often does this one occur?) are asked by chunk: documents are
dealt into chunks by a hash of id and text, each chunk asks about its distinct keys only, and the keys go in sorted,
compressed blocks to the shard that owns their range. A key that fills a third of the corpus is one key per chunk.
A shard takes many chunks' share of keys, so there are few shards to a chunk; a message holds one key at least, so
there are never more messages than keys.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import partitions_of, text_or_empty

U = np.uint64
MUL, ADD = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
CHUNK_BYTES = 10 << 20
#: Bytes of text whose keys one shard takes, and the least number of shards.
SHARD_BYTES, LEAST_SHARDS = 96 << 20, 64


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, extra: Iterable = ()) -> tuple[DataFrame, int, int]:
    """(chunk, doc_id, text), the number of chunks (about ``chunk_bytes`` of text each, no fewer than the input's splits), and that of shards."""
    total = docs.select(F.sum(F.octet_length(text_or_empty())).alias("n")).first().n or 0
    n = max(partitions_of(docs), -(-total // chunk_bytes), 1)
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.pmod(F.xxhash64(doc_id, text_or_empty()), F.lit(n)).cast("int").alias("chunk"), doc_id.alias("doc_id"), text_or_empty().alias("text"), *extra), n, max(LEAST_SHARDS, -(-total // SHARD_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def distinct_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The XXH3 hashes (64 bits) of the distinct words, and for each word its place among them."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), U, len(coded.dictionary)), coded.indices.to_numpy()


def word_hashes(words: list[bytes]) -> np.ndarray:
    own, place = distinct_hashes(words)
    return own[place]


def joined(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The hash of two sequences in a row, the first of ``size`` words. Not a polynomial, so no two words make colliding patterns."""
    return mix((a * MUL) ^ (b * ADD + U(size)))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of each position the hash of the n words from there, by doubling; the last n - 1 positions are left out."""
    if len(hashes) < n:
        return np.zeros(0, U)
    out, done, power, size, left = None, 0, hashes, 1, n
    while left:
        if left & 1:
            if out is None:
                out, done = power, size
            else:
                out = joined(out[: len(hashes) - done - size + 1], power[done : len(hashes) - size + 1], done)
                done += size
        left >>= 1
        if left:
            power = joined(power[:-size], power[size:], size)
            size *= 2
    return out


def split_words(texts: Iterable[str], lower: bool = False) -> tuple[list[list[bytes]], list[bytes], np.ndarray]:
    """Words (runs without ASCII white space) of each text, all of them in a row, and how many each text has."""
    parts = [(b.lower() if lower else b).split() for b in (t.encode("utf-8", "surrogatepass") for t in texts)]
    return parts, list(chain.from_iterable(parts)), np.fromiter(map(len, parts), np.int64, len(parts))


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of sorted keys begins, and the end."""
    step = (1 << 64) // shards + 1
    return np.searchsorted(keys, np.array([i * step for i in range(shards)], dtype=U)).tolist() + [len(keys)]


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b"")


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype) if len(raw) else np.zeros(0, dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U), dtype=U)
