"""The corpus queries (opN_<name>) over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.llm import compression_quality
from tidelex.llm.chat_trees import format_paths, linear_messages, read_loss, read_turns, reply_paths
from tidelex.llm.common import table
from tidelex.llm.exact_dedup import exact_duplicates
from tidelex.llm.katz import katz_scores
from tidelex.llm.line_runs import remove_repeated_runs
from tidelex.llm.mixing import mixing_rates
from tidelex.llm.passages import remove_repeated_passages
from tidelex.llm.sentencepiece_codec import encode_decode
from tidelex.llm.simhash import near_duplicates
from tidelex.llm.tandem_runs import looped, periodic_runs
from tidelex.llm.top_k import exact_top_k, quantised
from tidelex.llm.toxicity import fit, score, training_sample
from tidelex.llm.turn_repair import damaged, repair_report


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """A public vocabulary file; TIDELEX_TOKENIZERS names another folder."""
    if folder := os.environ.get("TIDELEX_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))  # a row for each that repeats doc_id and text
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"), window=35)


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated_runs(table(spark, sf_dir, "documents"), min_lines=3)
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"), words=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(training_sample(docs, labels)))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    rows = katz_scores(table(spark, sf_dir, "documents"), train=fold != 2)
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: A conversation whose texts look like the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"
#: Stands for a null conv_id, whose rows are one conversation.
NO_ID = ""


def op7_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").unionByName(own, allowMissingColumns=True)
    messages = linear_messages(rows.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_ID))))
    made = format_paths(reply_paths(messages, branches=1), messages)
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss_spans"))
    read = made.select(F.nullif("conv_id", F.lit(NO_ID)).cast("long").alias("conv_id"), "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"), scale=64.0)
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


#: Share of tokens per language, which stands for the domain: the fixtures' texts do not tell their sources apart.
TARGETS = {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = compression_quality.fit(compression_quality.labelled_sample(docs, labels, train=fold != 2))
    rows = compression_quality.score(docs, model)
    return rows.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(looped(table(spark, sf_dir, "documents")), min_words=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, dropped = damaged(table(spark, sf_dir, "conversations"))
    return repair_report(turns, absent=dropped)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_line_runs": op3_line_runs,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_katz": op6_katz,
    "op7_chat_trees": op7_chat_trees,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_mixing": op9_mixing,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_compression_quality": op11_compression_quality,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_turn_repair": op13_turn_repair,
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_line_runs": """
        WITH lines AS (
            SELECT doc_id, i - 1 AS line, parts[i] AS body, len(parts) AS n FROM (
                SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
            )
        ), windows AS (
            SELECT doc_id, line, n, row(body, lead(body, 1) OVER w, lead(body, 2) OVER w) AS run
            FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)
        ), ranked AS (
            SELECT doc_id, line, first_value(doc_id) OVER r AS first_doc, first_value(line) OVER r AS first_line
            FROM windows WHERE line + 3 <= n WINDOW r AS (PARTITION BY run ORDER BY doc_id, line)
        ), gone AS (
            SELECT DISTINCT doc_id, line + unnest([0, 1, 2]) AS line FROM ranked WHERE doc_id <> first_doc OR line >= first_line + 3
        )
        SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
               sha256(coalesce(string_agg(l.body, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id
    """,
    "op7_chat_trees": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), sized AS (
            SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS body FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(body + 4 + 2 + 8)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op8_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
