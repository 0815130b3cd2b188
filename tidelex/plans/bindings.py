"""How the library's inputs are bound to the driver's tables.

A document is a chunk, its source the company and 2005 + id % 20 its (surrogate) year; an embedding is a scored
vector whose label is the company. Axis poles are fixed sets of vector ids.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.functions.classify import REGISTERS, STANCES
from tidelex.functions.text import short_id, word_count
from tidelex.functions.vectors import build_axes, project
from tidelex.operators.models import embedder, labelled, labeller
from tidelex.operators.scoring import axes_of_sentences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", short_id(F.col("doc_id"), F.col("text")).alias("chunk_id"), F.col("source").alias("company"), (2005 + F.col("doc_id") % 20).cast("int").alias("year"), "text", "lang", word_count(F.col("text")).alias("word_count"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("company"), (2005 + F.col("vec_id") % 20).cast("int").alias("year"), "embedding")


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """altruism: ids under 8 against 8 to 15; control, inclusion and meritocracy: 16 to 23, 24 to 31, 32 to 39 alone."""
    v = table(spark, sf_dir, "embeddings").where("vec_id < 40")
    axis = F.when(F.col("vec_id") < 16, "altruism").when(F.col("vec_id") < 24, "control").when(F.col("vec_id") < 32, "inclusion").otherwise("meritocracy")
    pole = F.when(F.col("vec_id").between(8, 15), "b").otherwise("a")
    return build_axes(v.select(axis.alias("axis"), pole.alias("pole"), "embedding"))


def scored(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return project(vectors(spark, sf_dir), axes(spark, sf_dir).where(F.col("axis").isin(*names))).drop("embedding")


#: The same as SQL, for oracles: v (vectors with unit vectors), ax (axes) and s (scores by axis).
SQL = """
    WITH raw AS (SELECT vec_id, label AS company, (2005 + vec_id % 20)::INT AS year, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    v AS (SELECT vec_id, company, year, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM raw),
    pole AS (
        SELECT CASE WHEN vec_id < 16 THEN 'altruism' WHEN vec_id < 24 THEN 'control' WHEN vec_id < 32 THEN 'inclusion' ELSE 'meritocracy' END AS axis,
               vec_id BETWEEN 8 AND 15 AS b, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM v WHERE vec_id < 40
    ),
    comp AS (SELECT axis, i, avg(x) FILTER (NOT b) - coalesce(avg(x) FILTER (b), 0) AS x FROM pole GROUP BY axis, i),
    long AS (SELECT axis, list(x ORDER BY i) AS a FROM comp GROUP BY axis),
    ax AS (SELECT axis, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS vector FROM long),
    s AS (SELECT vec_id, company, year, axis, list_inner_product(u, vector) AS score FROM v, ax)
"""
CHUNK_SQL = """
    WITH c AS (
        SELECT doc_id, substr(sha256(concat_ws('|', doc_id, text)), 1, 16) AS chunk_id, source AS company, (2005 + doc_id % 20)::INT AS year, text, lang FROM documents
    )
"""


# Models that stand in for those of a provider: their answers follow from the text alone, so SQL can give them too.

#: Labels of chunks, fixed values; the last one is what an unknown label becomes.
CHUNK_LABELS = ["mission_brand", "employee_story", "job_listing", "benefits_perks", "process_logistics", "legal_boilerplate", "navigation_junk"]
_TOLD = ["mission_brand", "mission_brand", "benefits_perks", "mission_brand", "job_listing", "employee_story", "no such label", "benefits_perks"]


def digest_vectors(texts: list[str]) -> list[list[float]]:
    """Eight components from -1 to 1, from the first bytes of the text's SHA-256."""
    return [[(x - 127.5) / 127.5 for x in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]


def label_by_length(told: list[str]):
    """A model that replies, in a fence, with one of ``told`` for each text, by its length."""

    def complete(prompt: str, payload: str) -> str:
        found = [{"id": x["id"], "label": told[len(x["text"] or "") % len(told)]} for x in json.loads(payload)]
        return f"```json\n{json.dumps(found)}\n```"

    return complete


EMBEDDER = embedder("digest-8", digest_vectors)
LABELLER = labeller("length-labels", label_by_length(_TOLD), "Label each chunk.")
REGISTER_MODEL = labeller("length-registers", label_by_length([*REGISTERS, "none of these", "absent", "absent", "meritocracy"]), "Name each chunk's register.")
STANCE_MODEL = labeller("length-stances", label_by_length(["neutral", *STANCES, "?"]), "Name each chunk's stance.")


def analysed(spark: SparkSession, sf_dir: str, cache: str, wanted: list[str]) -> DataFrame:
    """The chunks that the model labels as one of ``wanted``, with their source as heading."""
    rows = chunks(spark, sf_dir).where("text is not null").select("doc_id", "chunk_id", "company", F.col("company").alias("heading"), "text")  # what a model gets is shuffled
    rows = rows.withColumn("year", (2005 + F.floor(F.col("doc_id") / 20) % 10).cast("int"))  # by id % 20 a source has one year
    return labelled(rows, LABELLER, cache, CHUNK_LABELS, CHUNK_LABELS[-1]).where(F.col("label").isin(wanted))


def sentence_axes(spark: SparkSession, sf_dir: str, cache: str) -> DataFrame:
    """Axes whose poles are benchmark texts: altruism by two poles, control, inclusion and meritocracy by one."""
    place = F.pmod("item_id", F.lit(5))
    axis = F.when(place <= 1, "altruism").when(place == 2, "control").when(place == 3, "inclusion").otherwise("meritocracy")
    poles = table(spark, sf_dir, "benchmark").where("text is not null").select(axis.alias("axis"), F.when(place == 1, "b").otherwise("a").alias("pole"), F.col("text").alias("sentence"))
    return axes_of_sentences(poles, EMBEDDER, cache)


def _case(told: list[str], allowed: list[str], default: str) -> str:
    return f"CASE length(text) % {len(told)} " + " ".join(f"WHEN {i} THEN '{x if x in allowed else default}'" for i, x in enumerate(told)) + " END"


_BYTE = "((('0x' || substr(sha256({0}), (2 * i + 1)::INT, 2))::INT - 127.5) / 127.5)::FLOAT::DOUBLE"
VECTOR = "list_transform(generate_series(0, 7), lambda i: " + _BYTE + ")"
LABEL_SQL = _case(_TOLD, CHUNK_LABELS, "navigation_junk")
REGISTER_SQL = _case([*REGISTERS, "none of these", "absent", "absent", "meritocracy"], REGISTERS, "absent")
STANCE_SQL = _case(["neutral", *STANCES, "?"], STANCES, "neutral")
#: From ``documents``: mc (labelled chunks with heading), bx (axes from benchmark texts).
MODEL_SQL = f"""
    WITH mc AS (
        SELECT doc_id, substr(sha256(concat_ws('|', doc_id, text)), 1, 16) AS chunk_id, source AS company, source AS heading, (2005 + doc_id // 20 % 10)::INT AS year, text,
               {LABEL_SQL} AS label, {REGISTER_SQL} AS register, {STANCE_SQL} AS stance FROM documents WHERE text IS NOT NULL
    ),
    bp AS (
        SELECT CASE WHEN item_id % 5 <= 1 THEN 'altruism' WHEN item_id % 5 = 2 THEN 'control' WHEN item_id % 5 = 3 THEN 'inclusion' ELSE 'meritocracy' END AS axis, item_id % 5 = 1 AS b, {VECTOR.format('text')} AS e FROM benchmark WHERE text IS NOT NULL
    ),
    bu AS (SELECT axis, b, unnest(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))) AS x, generate_subscripts(e, 1) AS i FROM bp),
    bc AS (SELECT axis, i, avg(x) FILTER (NOT b) - coalesce(avg(x) FILTER (b), 0) AS x FROM bu GROUP BY axis, i),
    bl AS (SELECT axis, list(x ORDER BY i) AS a FROM bc GROUP BY axis),
    bx AS (SELECT axis, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS vector FROM bl)
"""
