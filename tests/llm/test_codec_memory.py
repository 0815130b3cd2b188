"""What a task of the SentencePiece codec holds of a block of documents."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from tidelex.llm import queries
from tidelex.llm.sentencepiece_codec import Block, ChunkCodec, by_shard, own_text


def answers(codec, block, name_own):
    """What the shards tell of the block's words; with ``name_own`` also the texts that are the words' own."""
    for words in by_shard(block.at, 5).values():
        ids, texts = codec.segment(words)
        texts = [own_text(w) if t is None and name_own else t for w, t in zip(words, texts, strict=True)]
        yield words, pa.table({"ids": pa.array(ids, pa.list_(pa.uint16())), "text": pa.array(texts, pa.string())})


def test_block_like_the_library():
    with open(queries.tokenizer_path(), "rb") as f:
        codec = ChunkCodec(f.read())
    rng = np.random.default_rng(6)
    letters = list("ab ▁\n\t<>s/é🙂 .,'0x") + ["the", "ing", " of", "<s>", "　"]
    texts = ["", *("".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(700)), "", " "]
    block = Block(pa.chunked_array([texts[:300], texts[300:]]))
    want = [codec.sp.encode(t, add_bos=True, add_eos=True) for t in texts]
    for name_own in (False, True):
        got = list(block.coded(codec, answers(codec, block, name_own)))
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == want
        assert [t for _, t in got] == [codec.sp.decode(ids) for ids in want]
    nothing = Block(pa.chunked_array([["", ""]]))
    assert list(nothing.coded(codec, iter(()))) == [(codec.bos + codec.eos, "")] * 2


def test_block_has_a_string_for_each_distinct_word_only():
    """Four bytes a word and little more; as a string a word it was some 65."""
    words = [f"w{k}" for k in range(500)]
    texts = pa.chunked_array([[" ".join(words * 2)] * 400])
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        block = Block(texts)
        held = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert sum(map(len, block.parts)) == 400_000
    assert held < 400_000 * 8
