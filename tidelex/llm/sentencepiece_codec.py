"""SentencePiece encoding and decoding by a table of distinct chunks.

In a model whose pieces never hold a whitespace marker behind another character, and never a line break, no merge
crosses the place before a marker or a break. The text then falls into chunks (marked words) that are segmented on
their own. Documents travel in blocks. Each block sends its distinct marked words to the shards that own them; a shard
holds each word of the corpus once, segments it once with the library, and answers with ids in the order asked. The
blocks join the ids back to the words' positions. For any other model the texts go through the library whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.blocks import LEAST_SHARDS, SHARD_BYTES
from tidelex.llm.common import partitions_of, text_or_empty

MARK = "▁"
#: A run of markers or one line break, and what follows it up to the next.
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")
#: Most bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 12 << 20
#: Texts of a block, and words of a shard, that are Python objects at one time.
TEXTS_AT_ONCE, WORDS_AT_ONCE = 256, 1 << 14


class ChunkCodec:
    """Encodes and decodes like ``SentencePieceProcessor(model_file=...)`` with begin and end ids."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = pb.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        pieces = [p.piece for p in spec.pieces if p.type == 1]
        inner = any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        special = any(p.type == 4 for p in spec.pieces) or spec.HasField("denormalizer_spec") and spec.denormalizer_spec.precompiled_charsmap
        self.chunked = bool(plain and not inner and not special and not spec.trainer_spec.treat_whitespace_as_suffix and spec.trainer_spec.byte_fallback)
        self.bos, self.eos = self._pack([self.sp.bos_id()]), self._pack([self.sp.eos_id()])
        self.lead = self.sp.encode("\n") if self.chunked else []

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    @staticmethod
    def chunks(text: str) -> list[str]:
        return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, chunks: list[str]) -> tuple[list[list[int]], list[str | None]]:
        """Ids and decoded text of each chunk, behind a break, where the library adds and drops no marker; None for a text that is the chunk's own."""
        ids = [x[len(self.lead) :] for x in self.sp.encode(["\n" + c for c in chunks], num_threads=1)]
        texts = self.sp.decode([[*self.lead, *x] for x in ids], num_threads=1)
        return ids, [None if t[1:] == own_text(c) else t[1:] for c, t in zip(chunks, texts, strict=True)]

    def whole(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        for text in texts:
            ids = self.sp.encode(text, add_bos=True, add_eos=True)
            yield self._pack(ids), self.sp.decode(ids)

    def placed(self, parts: list[list[str]], table: dict[str, tuple[bytes, str]]) -> Iterator[tuple[bytes, str]]:
        """Of each text, given as chunks, its ids as little-endian 32-bit integers and the text decoded from them."""
        for chunks in parts:
            found = [table[c] for c in chunks]
            yield b"".join([self.bos, *[x[0] for x in found], self.eos]), "".join([x[1] for x in found])[1:]


def own_text(chunk: str) -> str:
    return chunk.replace(MARK, " ")


def packed(**columns: pa.Array) -> bytes:
    """The columns as one compressed Arrow stream."""
    rows, out = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def in_blocks(docs: DataFrame) -> DataFrame:
    """block long, data binary: the documents (doc_id, text) in compressed blocks, named by a hash of what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(pc.utf8_length(b["text"]).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_BYTES
            edges = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1], True]) if b.num_rows else []
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(begin, end - begin)
                data = packed(doc_id=part["doc_id"], text=part["text"])
                yield pa.RecordBatch.from_pydict({"block": pa.array([xxhash.xxh3_64_intdigest(data) >> 1], pa.int64()), "data": pa.array([data], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "block long, data binary")


def some_at_a_time(texts: pa.ChunkedArray) -> Iterator[str]:
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        yield from texts.slice(at, TEXTS_AT_ONCE).to_pylist()


class Block:
    """The texts of a block as places of their chunks among its distinct ones: four bytes a word, not a string each."""

    def __init__(self, texts: pa.ChunkedArray):
        self.texts, self.at = texts, {}
        at = self.at
        self.parts = [np.array([at.setdefault(c, len(at)) for c in ChunkCodec.chunks(t)], np.int32) for t in some_at_a_time(texts)]

    def coded(self, codec: ChunkCodec, answers: Iterator[tuple[list[str], pa.Table]]) -> Iterator[tuple[bytes, str]]:
        """As ``ChunkCodec.placed``; the answers (ids, text) of some chunks each, of all of them together."""
        begin, size = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        flat, n, other = [], 0, {}
        for words, told in answers:
            places = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            ids = told["ids"].combine_chunks()
            flat.append(ids.flatten().to_numpy())
            size[places] = ids.value_lengths().to_numpy()
            begin[places] = n + np.r_[0, np.cumsum(size[places])[:-1]]
            n += len(flat[-1])
            differ = np.flatnonzero(told["text"].is_valid().to_numpy())
            other |= zip(places[differ].tolist(), told["text"].take(pa.array(differ)).to_pylist(), strict=True)
        all_ids, names, differs = np.concatenate([*flat, np.zeros(0, np.uint16)]), list(self.at), np.zeros(len(self.at), bool)
        differs[list(other)] = True
        for text, part in zip(some_at_a_time(self.texts), self.parts, strict=True):
            if differs[part].any():
                table = {names[i]: (all_ids[begin[i] : begin[i] + size[i]].astype("<u4").tobytes(), other[i] if i in other else own_text(names[i])) for i in set(part.tolist())}
                yield from codec.placed([[names[i] for i in part.tolist()]], table)
            else:
                many = size[part]
                ids = all_ids[np.repeat(begin[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                yield b"".join([codec.bos, ids.astype("<u4").tobytes(), codec.eos]), own_text(text)


def by_shard(words: Iterable[str], shards: int) -> dict[int, list[str]]:
    """The words, sorted, of each shard that owns any."""
    out: dict[int, list[str]] = {}
    for w in sorted(words):
        out.setdefault(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % shards, []).append(w)
    return out


def encode_decode(docs: DataFrame, model_path: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with ``keep_ids`` ids array<int>, with ``keep_text`` decoded.

    A null text counts as empty and gives the begin and end ids only. Repeated rows give repeated rows, an empty table
    none. A very long text is a block of its own. Only doc_id and text are read and only the columns named are
    returned, so other columns may have any names. The model file is read once on the driver; its bytes (the
    vocabulary's fixed size) go along with the tasks.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    model = docs.sparkSession.sparkContext.broadcast(data)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def rows_of(doc_ids: pa.Array, coded: Iterator[tuple[bytes, str]]) -> pa.Table:
        n, ids_hex, text_hex, ids_out, texts = [], [], [], [], []
        for ids, decoded in coded:
            n.append(len(ids) // 4)
            ids_hex.append(hashlib.sha256(ids).hexdigest())
            text_hex.append(hashlib.sha256(decoded.encode()).hexdigest())
            if keep_ids:
                ids_out.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
            if keep_text:
                texts.append(decoded)
        cols = {"doc_id": doc_ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hex, pa.string()), "decoded_sha256": pa.array(text_hex, pa.string())}
        cols |= {"ids": pa.array(ids_out, pa.list_(pa.int32()))} if keep_ids else {}
        return pa.table(cols | ({"decoded": pa.array(texts, pa.string())} if keep_text else {}))

    if not ChunkCodec(data).chunked:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = ChunkCodec(model.value)
            for batch in batches:
                yield from rows_of(batch["doc_id"], codec.whole(batch["text"].to_pylist())).to_batches()

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)

    splits = partitions_of(docs)
    shards = max(LEAST_SHARDS, splits * BLOCK_BYTES // SHARD_BYTES)
    blocks = in_blocks(docs).repartition(max(splits, 8), "block")

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        words: set[str] = set()
        for blob in group["data"].to_pylist():
            for t in some_at_a_time(unpacked(blob)["text"]):
                words.update(ChunkCodec.chunks(t))
        held = by_shard(words, shards)
        return pa.table({"shard": pa.array(list(held), pa.int32()), "block": pa.array([key[0].as_py()] * len(held), pa.int64()), "words": pa.array([packed(w=pa.array(x, pa.string())) for x in held.values()], pa.binary())})

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        asked = [unpacked(x)["w"].combine_chunks() for x in group["words"].to_pylist()]
        at = pa.concat_arrays(asked).dictionary_encode()  # the words once, and where each question has them
        codec = ChunkCodec(model.value)
        kind = pa.schema({"ids": pa.list_(pa.uint16() if codec.sp.get_piece_size() <= 1 << 16 else pa.uint32()), "text": pa.string()})
        tables = (codec.segment(at.dictionary.slice(k, WORDS_AT_ONCE).to_pylist()) for k in range(0, len(at.dictionary), WORDS_AT_ONCE))
        table = pa.concat_tables([pa.table({"ids": ids, "text": texts}, kind) for ids, texts in tables]).combine_chunks()
        ends = np.cumsum([0, *map(len, asked)]).tolist()
        told = [table.take(at.indices.slice(begin, end - begin)) for begin, end in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"block": group["block"], "shard": group["shard"], "told": pa.array([packed(ids=t["ids"].combine_chunks(), text=t["text"].combine_chunks()) for t in told], pa.binary())})

    def place(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
        docs_of = pa.concat_tables([unpacked(blob) for blob in group["data"].to_pylist()])
        block = Block(docs_of["text"])
        held = by_shard(block.at, shards)
        answers = ((held[shard], unpacked(blob)) for shard, blob in zip(told["shard"].to_pylist(), told["told"].to_pylist(), strict=True))
        return rows_of(docs_of["doc_id"].combine_chunks(), block.coded(ChunkCodec(model.value), answers))

    asked = blocks.groupBy("block").applyInArrow(ask, "shard int, block long, words binary")
    told = asked.groupBy("shard").applyInArrow(answer, "block long, shard int, told binary")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(place, schema)
