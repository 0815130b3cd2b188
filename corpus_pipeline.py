"""A training corpus from documents in five stages, each written as Parquet and read by the next.

In every stage a null text counts as empty, texts are read whole however long they are, an empty table gives an empty
one, and columns beside doc_id, text and lang may have any names; all stages but the last keep them as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.llm import queries
from tidelex.llm.common import scratch, table, unused
from tidelex.llm.exact_dedup import drop_exact_duplicates
from tidelex.llm.mixing import mix_documents
from tidelex.llm.sentencepiece_codec import encode_decode
from tidelex.llm.shingle_copies import drop_near_copies
from tidelex.llm.toxicity import fit, score, training_sample

#: Bounds the copies of a document where the documents hold next to nothing of a domain.
MAX_RATE = 16.0
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5.

    Rows that repeat, or have no doc_id, are scored each. Without labels of both kinds there is nothing to tell documents
    apart by, and none goes.
    """
    model = fit(training_sample(docs, table(spark, sf_dir, "labels")))
    if not model.weights:
        return docs
    (column,) = unused(docs, "toxicity")
    return score(docs, model, keep=column).where(F.col(column) < 0.5).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id; empty texts are equal.

    A null doc_id stays only where no equal text has one. Rows that repeat doc_id and text stay once; if they differ in other
    columns, one of them stays whole.
    """
    return drop_exact_duplicates(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies over shingles of five words.

    Groups are chains of links: fingerprints within SimHash's three bits, and texts of a similarity of 0.8 or more.
    """
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights takes them, at most ``MAX_RATE`` times as many in expectation.

    Where that bound, or what the documents hold, puts a target out of reach, a warning tells by how much. Rows that
    repeat a doc_id, or have none, are copied as often as each other. Without labelled rows nothing tells the domains apart.
    """
    return mix_documents(docs, table(spark, sf_dir, "labels"), queries.TARGETS, max_rate=MAX_RATE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids of every document, and digests of the ids and of the text decoded from them; other columns are left out.

    Repeated rows are encoded each; an empty text has the begin and the end id.
    """
    return encode_decode(docs, queries.tokenizer_path(), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: The classifiers, fingerprints and tokens can't be written in SQL; the tests hold the stages to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"stage-{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
