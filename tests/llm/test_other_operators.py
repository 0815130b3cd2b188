"""Reply trees, exact top-k, SentencePiece and the pipeline."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelex.llm import queries
from tidelex.llm.blocks import chunked, pack, unpack
from tidelex.llm.chat_trees import escape, format_paths, linear_messages, read_loss, read_turns, reply_paths, unescape
from tidelex.llm.common import table
from tidelex.llm.katz import _summed
from tidelex.llm.sentencepiece_codec import ChunkCodec, encode_decode, own_text
from tidelex.llm.shingle_copies import copy_components, simhash_links
from tidelex.llm.top_k import exact_top_k, narrowest, quantised

from ..conftest import DATA
from .conftest import LONG, PAIRS

# reply trees

MESSAGES = "conv_id long, msg_id long, parent_id long, role string, text string, score double, leaf_id string, step string"


def tree(spark, *rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], MESSAGES)


def test_best_path_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", None), (1, 5, 3, "user", "other", 0.0), (1, 6, 4, "assistant", "end", 1.0)]
    messages = tree(spark, *rows)
    every = reply_paths(messages, branches=None).collect()
    by_branch = {b: [r.msg_id for r in sorted(every, key=lambda r: r.step) if r.branch == b] for b in {r.branch for r in every}}
    assert by_branch == {1: [1, 3, 4, 6], 2: [1, 3, 5], 3: [1, 2]}
    made = format_paths(reply_paths(messages, 1), messages).first()
    assert made.formatted == "### user: q</turn>\n### assistant: good</turn>\n### user: more</turn>\n### assistant: end</turn>\n"
    assert [made.formatted[s.start : s.start + s.length] for s in made.loss_spans] == ["good", "end"]


def test_deep_chain_and_ties(spark):
    n = 300
    chain = tree(spark, *[(5, k, k - 1 if k else None, "user", f"t{k}", 1.0) for k in range(n)], (6, 1, None, "user", "a", 1.0), (6, 3, 1, "user", "b", 1.0), (6, 2, 1, "user", "c", 1.0))
    paths = reply_paths(chain, branches=None).collect()
    assert sorted((r.step, r.msg_id) for r in paths if r.conv_id == 5) == [(k, k) for k in range(n)]
    assert {r.leaf_id for r in paths if r.conv_id == 6 and r.branch == 1} == {2}  # a tie goes to the smaller leaf


def test_trees_awkward(spark):
    rows = [(1, 1, 2, "user", "on a cycle", 1.0), (1, 2, 1, "user", "on a cycle", 1.0), (1, 3, 2, "user", "below it", 1.0), (2, 7, 99, None, None, None), (2, 7, 99, None, None, None), (None, 1, None, "user", "x", 1.0), (3, None, None, "user", "x", 1.0), (4, 1, 1, "user", "its own parent", 1.0)]
    messages = tree(spark, *rows)
    made = format_paths(reply_paths(messages), messages).collect()
    assert [(r.conv_id, r.formatted, r.loss_spans) for r in made] == [(2, "### : </turn>\n", [])]
    empty = messages.limit(0)
    assert format_paths(reply_paths(empty), empty).count() == 0


def test_one_row_of_a_repeated_message(spark):
    """Parent, score, role and text of a message come from one row."""
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, None, "user", "q2", float("nan")), (1, 3, 2, "assistant", "a text", 1.0), (1, 3, 1, "assistant", "z text", 1.0), (1, 4, 2, "assistant", "other", 0.5)]
    messages = tree(spark, *rows)
    made = {r.leaf_id: r.formatted for r in format_paths(reply_paths(messages, None), messages).collect()}
    assert made == {3: "### user: q</turn>\n### assistant: z text</turn>\n", 4: "### user: q2</turn>\n### assistant: other</turn>\n"}
    assert [r.leaf_id for r in reply_paths(messages, 1).where("step = 0").collect()] == [3]


TEXTS = ["", "\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\b\\l\\h\\c", "a\\\\b<#:", "🙂 é </turn", LONG]


def test_round_trip(spark):
    rows = [(k, t, role, x) for k, (t, role, x) in enumerate((t, role, x) for x in TEXTS for t, role in ((None, "user"), (3, "assistant"), (3, "as:sis#tant: ")))]
    conversations = spark.createDataFrame([(k // 3, t, role, x) for k, t, role, x in rows], "conv_id long, turn long, role string, text string")
    messages = linear_messages(conversations)
    made = format_paths(reply_paths(messages), messages).select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in made.collect():
        x = TEXTS[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [("user", x), ("as:sis#tant: ", x), ("assistant", x)]
        assert r.loss == x
    assert spark.range(1).select(unescape(escape(F.lit(TEXTS[3])))).first()[0] == TEXTS[3]


# top-k

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank string, query_id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], VECTORS)


def by_hand(rows, is_query, k):
    usable = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = Counter()
    for q, x in usable:
        if is_query(q):
            scored = sorted((-int(x @ y), c) for c, y in usable if c != q and len(y) == len(x))
            out.update((q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k]))
    return out


@pytest.mark.parametrize(("k", "blocks", "shards"), [(1, 1024, 8192), (5, 7, 11), (20, 3, 4), (500, 10, 10)])
def test_top_k(spark, k, blocks, shards):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 3]) for i in range(150)]  # many ties
    rows += [(200, None), (220, [None, 1.0, 1.0, 1.0]), (240, [float("nan")] * 4), (260, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (280, []), (300, [1.0, 2.0]), (320, [2.0, 1.0]), (301, [3e4] * 4)]
    rows += [r for r in rows if r[0] is not None and r[0] < 30]  # repeated rows count again
    rows += [(7, [1.0] * 4)] * 30 + [(40, [0.5] * 4)]
    frame = quantised(vectors(spark, rows))
    got = exact_top_k(frame, frame.where("vec_id % 20 = 0"), k, blocks, shards).collect()
    assert Counter(map(tuple, got)) == by_hand(rows, lambda i: i % 20 == 0, k)


def test_top_k_sql_on_repeated_rows(spark, tmp_path, check_sql):
    """The query and its SQL agree on repeated queries and candidates; null and odd vectors take no part."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 3]) for i in range(90)]
    rows += rows[:45:3] + rows[:21:20] + [(20, [0.25] * 4), (None, [1.0] * 4), (5, None), (6, [None, 1.0, 1.0, 1.0]), (60, [float("nan")] * 4)]
    vectors(spark, rows).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    sql = queries.ORACLE_SQL["op8_exact_top_k"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    check_sql(queries.op8_exact_top_k(spark, str(tmp_path)), sql, f"{DATA}/sf0.001")


def test_top_k_large_values_and_empty(spark):
    rows = [(i, [float(1 << 24), float(i), -float(i)]) for i in range(0, 60)]
    frame = quantised(vectors(spark, rows), scale=16.0)  # products beyond what doubles hold, within 64 bits
    got = exact_top_k(frame, frame.where("vec_id % 20 = 0"), 5).collect()
    assert len(got) == 15 and all(r.rank <= 5 for r in got)
    by_int = {i: [int(np.floor(x * 16)) for x in v] for i, v in rows}
    want = {(q, r + 1, c, -s) for q in range(0, 60, 20) for r, (s, c) in enumerate(sorted((-sum(a * b for a, b in zip(by_int[q], by_int[c], strict=True)), c) for c in by_int if c != q)[:5])}
    assert set(map(tuple, got)) == want
    none = frame.limit(0)
    assert exact_top_k(none, none).count() == exact_top_k(frame.limit(1), frame.limit(1)).count() == 0


def test_top_k_overflow_is_an_error(spark):
    wide = quantised(vectors(spark, [(0, [1e30, 0.0]), (1, [1.0, 0.0])]))
    with pytest.raises(Exception, match="does not fit 64 bits"):
        exact_top_k(wide, wide, 5).collect()
    product = quantised(vectors(spark, [(0, [1e16, 0.0]), (1, [1e16, 0.0])]))
    with pytest.raises(Exception, match="does not fit 64 bits"):
        exact_top_k(product, product, 5).collect()
    near = quantised(vectors(spark, [(0, [2.0**30, 2.0**30]), (1, [2.0**24, -(2.0**24)]), (2, [1.0, 0.0])]), scale=64.0)  # sums that cancel
    assert [tuple(r) for r in exact_top_k(near, near.where("vec_id = 0"), 5).collect()] == [(0, 1, 2, 64 * 64 * 2**30), (0, 2, 1, 0)]


def test_top_k_two_vectors_under_one_id(spark):
    frame = quantised(vectors(spark, [(0, [2.0]), (0, [1.0]), (1, [1.0]), (1, [3.0])]))
    got = Counter(tuple(r) for r in exact_top_k(frame, frame.where("vec_id = 0"), 5).collect())
    assert got == Counter([(0, 1, 1, 64 * 192), (0, 2, 1, 64 * 64), (0, 1, 1, 128 * 192), (0, 2, 1, 128 * 64)])


@pytest.mark.parametrize(("largest", "kind"), [(0, "tinyint"), (127, "tinyint"), (128, "smallint"), (1 << 15, "int"), (1 << 31, "bigint"), ((1 << 63) - 1, "bigint")])
def test_narrowest(largest, kind):
    assert narrowest(largest) == kind


# SentencePiece


def library(pairs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    out = []
    for i, t in pairs:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        out.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return Counter(out)


ODD = ["▁", " ", "  ", "a  b", " lead", "trail ", "▁▁x▁", "\n\n", "\n a\n", "<s>", "</s> <unk>", "<0x41>", "é́", "​﻿", "🙂" * 5, "\t\ttabs", "x" * 3000, "a\rb\r\nc", "  para", "١٢٣ हिन्दी 漢字かな"]


def test_sentencepiece_like_the_library(frame, none):
    pairs = [*PAIRS, *((300 + k, t) for k, t in enumerate(ODD))]
    assert Counter(map(tuple, encode_decode(frame(*pairs), queries.tokenizer_path()).collect())) == library(pairs)
    assert encode_decode(none, queries.tokenizer_path()).count() == 0


def test_sentencepiece_random_texts():
    with open(queries.tokenizer_path(), "rb") as f:
        codec = ChunkCodec(f.read())
    assert codec.chunked
    rng = np.random.default_rng(4)
    letters = list("ab ▁\n\t<>s/é🙂 .,'0x") + ["the", "ing", " of", "<s>", "　"]
    for _ in range(40):
        texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(25)]
        want = [codec.sp.encode(t, add_bos=True, add_eos=True) for t in texts]
        parts = [codec.chunks(t) for t in texts]
        words = sorted(set().union(*parts))
        ids, decoded = codec.segment(words)
        known = {c: (np.asarray(i, "<u4").tobytes(), own_text(c) if t is None else t) for c, i, t in zip(words, ids, decoded, strict=True)}
        for (ids, decoded), w in zip(codec.placed(parts, known), want, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == w and decoded == codec.sp.decode(w)


def test_sentencepiece_in_blocks(frame):
    """Many documents to a block and texts above a block's size give what one block gives, and two equal blocks are both there."""
    pairs = [*((k, t) for k, t in PAIRS), (40, LONG[:900]), (40, LONG[:900])]
    model = queries.tokenizer_path()
    assert Counter(map(tuple, encode_decode(frame(*pairs, partitions=1), model).collect())) == library(pairs)
    assert Counter(map(tuple, encode_decode(frame(*pairs, partitions=len(pairs)), model).collect())) == library(pairs)


def test_sentencepiece_whole_table(spark, small):
    pairs = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op10_sentencepiece(spark, small).collect())) == library(pairs)


# the pipeline


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    rows = {name: None for name, _ in corpus_pipeline.STAGES}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, small).checkpoint()
        rows[name] = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "exact_dedup":
            texts = [r.text or "" for r in docs.collect()]
            assert len(texts) == len(set(texts)) == len({r.text or "" for r in before.collect()})
        if name == "near_dedup":
            least = {r.node: r.component for r in copy_components(before, start=simhash_links(before)).collect()}
            assert {least.get(r.doc_id, r.doc_id) for r in before.collect()} == {r.doc_id for r in docs.collect()}
        if name == "sentencepiece":
            pairs = [(r.doc_id, r.text) for r in before.collect()]
            assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()) == library(pairs)
    assert 0 < rows["near_dedup"] <= rows["exact_dedup"] <= rows["toxicity"] <= table(spark, small, "documents").count()
    assert corpus_pipeline.run(spark, small).count() == rows["sentencepiece"]


def test_mixing_stage_bounds_copies(spark, frame, small):
    docs = frame(*PAIRS[:13])  # next to nothing of three of the four languages
    out = corpus_pipeline.mix_sources(spark, docs, small)
    assert out.columns == docs.columns and 0 < out.count() <= len(PAIRS[:13]) * (corpus_pipeline.MAX_RATE + 1)
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), small).count() == 0


def test_pipeline_drops_toxic_and_keeps_clean(spark, middle):
    docs, labels = table(spark, middle, "documents"), table(spark, middle, "labels")
    kept = corpus_pipeline.drop_toxic(spark, docs, middle).select("doc_id").withColumn("kept", F.lit(1))
    rows = labels.join(docs.select("doc_id"), "doc_id").join(kept, "doc_id", "left").groupBy("toxic").agg(F.count("kept").alias("kept"), F.count("*").alias("n")).collect()
    share = {r.toxic: r.kept / r.n for r in rows}
    assert share[0] > 0.95 and share[1] < 0.2


# conversations as a whole, and chunks


def test_chat_query_on_null_ids_and_nothing(spark, tmp_path, check_sql):
    """Rows without conv_id are a conversation; an empty table leaves conversation -7; code and SQL agree on both."""
    schema = "conv_id long, turn long, role string, text string, score double, leaf_id string, formatted string"
    rows = [(None, 0, "user", "q"), (None, None, "assistant", "first"), (3, 1, None, None), (3, 1, "assistant", "a<b>\\"), (3, 0, "us:er#", "x" * 300_000), (4, None, "assistant", "")]
    for name, held in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(*r, 1.0, "x", "y") for r in held], schema).write.parquet(str(folder / "conversations.parquet"))
        sql = queries.ORACLE_SQL["op7_chat_trees"].replace("FROM conversations", f"FROM '{folder}/conversations.parquet/*.parquet'")
        found = queries.op7_chat_trees(spark, str(folder))
        check_sql(found, sql, f"{DATA}/sf0.001")
        assert found.count() == (4 if held else 1)


def test_chunks_spread_rows_without_ids(spark):
    """Nine in ten rows have no id, and one id repeats; texts deal them out."""
    docs = spark.range(1000).select(F.when(F.col("id") >= 900, F.col("id")).when(F.col("id") >= 800, F.lit(7)).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows, n, _ = chunked(docs, chunk_bytes=800)
    sizes = [r["count"] for r in rows.groupBy("chunk").count().collect()]
    assert n >= 8 and max(sizes) <= 3 * 1000 / n


def test_counts_beyond_32_bits():
    many = (1 << 31) - 1
    keys = [np.array([3, 9], np.uint64), np.array([3], np.uint64)]
    held, _, total, place = _summed(keys, [np.array([many, 1], np.int32), np.array([many], np.int32)])
    told = unpack(pack(total[place]), np.int64)
    assert held.tolist() == [3, 9] and told.tolist() == [2 * many, 1, 2 * many]


@pytest.mark.parametrize("taught", [True, False])
def test_pipeline_on_awkward_and_empty_tables(spark, awkward, none, tmp_path, taught):
    """Every stage takes nulls, repeats, long texts, clashing names and nothing at all, with and without labels."""
    labels = [(5, 1, 0), (6, 1, 0), (7, 0, 0), (10, 1, 0), (11, 1, 0), (8, 0, 1), (12, None, None), (None, 1, 1)] if taught else []
    for name, docs in (("some", awkward), ("none", none)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = table(spark, folder, "documents")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, rows, folder)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert made.columns == docs.columns
                made.write.parquet(f"{folder}/{k}")
                rows = spark.read.parquet(f"{folder}/{k}")
        assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(made.columns)
        assert made.count() == rows.count() and (made.count() > 0) == (name == "some")
        assert corpus_pipeline.run(spark, folder).count() == made.count()
