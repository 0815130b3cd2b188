"""Models outside the library, asked cache first: what the cache holds is never asked again.

A model is a function from the rows of one batch to their answers. Missing rows are numbered over the whole table, so
that every batch but the last is full however the rows are spread, and each batch is one call in one task. Answers
are kept in the shared folder before they are appended to the cache, so a failed append asks nothing anew; a batch whose
executor is lost before that is asked again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.functions.classify import coerce
from tidelex.operators.dedup import first_per
from tidelex.sources import path_exists
from tidelex.storage import cut, kept

EMBED_BATCH, LABEL_BATCH = 100, 25


@dataclass(frozen=True)
class Model:
    """``ask`` gets the rows of a batch as dicts and returns one answer for each, None for none; ``answer`` is the answers' type."""

    name: str
    ask: Callable[[list[dict]], list]
    answer: str
    batch: int


def embedder(name: str, embed: Callable[[list[str]], list], batch: int = EMBED_BATCH) -> Model:
    """A model of vectors for texts."""
    return Model(name, lambda rows: embed([r["text"] for r in rows]), "array<float>", batch)


def reply_labels(reply: str) -> dict[str, str]:
    """id to label of a reply that is a JSON array of {id, label}, bare or in a fence."""
    body = reply.strip()
    if body.startswith("```"):
        body = body.strip("`").strip().removeprefix("json")
    try:
        return {str(x["id"]): x["label"] for x in json.loads(body)}
    except (ValueError, TypeError, KeyError) as e:
        raise ValueError(f"not a JSON array of id and label: {reply[:200]!r}") from e


def labeller(name: str, complete: Callable[[str, str], str], prompt: str, key: str = "chunk_id", columns: tuple[str, ...] = ("heading", "text"), batch: int = LABEL_BATCH) -> Model:
    """A model of labels: ``complete`` gets the prompt and the batch as JSON and replies with the labels by id."""

    def ask(rows: list[dict]) -> list:
        payload = json.dumps([{"id": r[key], **{c: r[c] for c in columns}} for r in rows], ensure_ascii=False)
        found = reply_labels(complete(prompt, payload))
        return [found.get(str(r[key])) for r in rows]

    return Model(name, ask, "string", batch)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their place, from 0, in ``order`` over the whole table.

    Ranges number their own rows; where each begins follows from one small row a range, which is all that meets in
    one task. Ties get places in an order of their own that a new run may change.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__own", F.monotonically_increasing_id()))
    part = F.shiftright("__own", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    begin = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__begin"))
    placed = ranged.withColumn("__part", part).join(F.broadcast(begin), "__part")
    return placed.withColumn(name, F.col("__begin") + F.col("__own").bitwiseAND((1 << 33) - 1)).drop("__own", "__part", "__begin")


def cached(spark: SparkSession, cache: str, model: Model, key: str) -> DataFrame:
    """key, answer of all that the cache holds of a model now; of a key that two overlapping runs have asked, the least answer.

    Spark takes two reads of one folder for the same, whatever was appended between them, and may use the result of
    the first for both; so each read has an option of its own.
    """
    schema = f"{key} string, answer {model.answer}, model string"
    rows = spark.read.schema(schema).option("readAs", uuid.uuid4().hex).parquet(cache) if path_exists(spark, cache) else spark.createDataFrame([], schema)
    return rows.where(F.col("model") == model.name).groupBy(key).agg(F.min("answer").alias("answer"))


def ask_missing(rows: DataFrame, key: str, model: Model, cache: str, order: list[str], finish: Callable[[Column], Column] | None = None) -> None:
    """Ask the model for every key that its cache lacks, once and in full batches in ``order``, and append the answers.

    Of rows that repeat a key the first in ``order`` is asked for. Rows without a key are not asked for, and an answer of
    None is not kept, so it is asked again the next time. ``finish`` is applied to answers before they are kept.
    """
    known = cached(rows.sparkSession, cache, model, key)
    there = rows.where(F.col(key).isNotNull())
    places = there.select(key, *[c for c in order if c != key])  # without the texts
    wanted = places.distinct() if order == [key] else first_per(places, [key], order)
    missing = wanted.join(known.select(key), key, "left_anti")
    batches = numbered(missing, order, "__at").select(key, "__at", F.floor(F.col("__at") / model.batch).alias("__batch"))
    batches = first_per(there.join(batches, key), [key], order)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in f.to_dict("records"))
        keys, told = [], []
        for _, batch in groupby(rows, lambda r: r["__batch"]):
            asked = [{c: v for c, v in r.items() if c not in ("__at", "__batch")} for r in batch]
            answers = list(model.ask(asked))
            if len(answers) != len(asked):
                raise ValueError(f"{model.name} gave {len(answers)} answers for {len(asked)} rows")
            keys += [r[key] for r in asked]
            told += answers
            if len(keys) >= 1000:
                yield pd.DataFrame({key: keys, "answer": told})
                keys, told = [], []
        if keys:
            yield pd.DataFrame({key: keys, "answer": told})

    whole = batches.repartition("__batch").sortWithinPartitions("__batch", "__at")  # a batch lies in one task, in order
    answers = whole.mapInPandas(call, f"{key} string, answer {model.answer}").where("answer is not null")
    if finish is not None:
        answers = answers.withColumn("answer", finish(F.col("answer")))
    paid = kept(answers, "answers")
    paid.withColumn("model", F.lit(model.name)).write.mode("append").partitionBy("model").parquet(cache)


def answers_of(rows: DataFrame, key: str, model: Model, cache: str, name: str, order: list[str], finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """key and the model's answer for it as ``name``; keys without an answer have no row."""
    ask_missing(rows, key, model, cache, order, finish)
    return cached(rows.sparkSession, cache, model, key).select(F.col(key), F.col("answer").alias(name))


def with_answers(rows: DataFrame, key: str, model: Model, cache: str, name: str, order: list[str], finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows and the model's answer for each in a new column, null where there is none."""
    answers = answers_of(rows, key, model, cache, name, order, finish)
    return rows.join(answers, key, "left").select(*rows.columns, name)


def embedded(rows: DataFrame, model: Model, cache: str, text: str = "text", name: str = "embedding") -> DataFrame:
    """The rows with the vector of their text, asked for once for each different text by its SHA-256; null for a null text."""
    texts = rows.select(F.sha2(text, 256).alias("hash"), F.col(text).alias("text")).where("hash is not null")
    ask_missing(texts, "hash", model, cache, ["hash"])
    answers = cached(rows.sparkSession, cache, model, "hash").select(F.col("hash").alias("__hash"), F.col("answer").alias(name))
    return rows.withColumn("__hash", F.sha2(text, 256)).join(answers, "__hash", "left").drop("__hash")


def labelled(chunks: DataFrame, model: Model, cache: str, allowed: list[str], default: str, name: str = "label", key: str = "chunk_id") -> DataFrame:
    """The chunks with the model's label, the default where it names none of ``allowed``; null where it gives none."""
    return labelled_by(chunks, [(model, allowed, default, name)], cache, key)


def labelled_by(chunks: DataFrame, models: list[tuple[Model, list[str], str, str]], cache: str, key: str = "chunk_id") -> DataFrame:
    """The chunks with the labels of several (model, allowed, default, name), each as ``labelled`` gives it; no model waits for what another said."""
    out = chunks
    for model, allowed, default, name in models:
        answers = answers_of(chunks, key, model, cache, name, [key], lambda answer, allowed=allowed, default=default: coerce(answer, allowed, default))
        out = out.join(answers, key, "left").select(*out.columns, name)
    return out
