"""What texts say along axes, year by year: an axis at the level of chunks and of sentences, and two poles as a stance.

Texts have company, year, chunk_id, heading, text. Vectors come from a model that is asked cache first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.functions.classify import COUNTER_REGISTERS, REGISTERS
from tidelex.functions.text import sentences, short_id
from tidelex.functions.vectors import build_axes, project
from tidelex.operators import rollup
from tidelex.operators.dedup import first_per, near_duplicates_removed
from tidelex.operators.models import Model, embedded
from tidelex.storage import kept

Dedup = Callable[[DataFrame, list[str]], DataFrame]
QUOTE_CHARS = 400


def exact_dedup(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Of equal texts of a scope the one with the smallest chunk_id."""
    return first_per(rows, [*scope, "text"], ["chunk_id"])


def near_dedup(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Of texts of a scope that are nearly alike the longest, ties to the smaller chunk_id."""
    return near_duplicates_removed(rows, scope, "text", "chunk_id")


def axes_of_sentences(poles: DataFrame, model: Model, cache: str) -> DataFrame:
    """axis, single_pole, vector from (axis, pole, sentence) rows."""
    return build_axes(embedded(poles, model, cache, text="sentence").select("axis", "pole", "embedding"))


def sentence_rows(chunks: DataFrame) -> DataFrame:
    """sentence_id, company, year, chunk_id, heading, text: the sentences of chunks, each once a year of its company.

    Of a sentence that repeats, that of the smallest chunk_id and then position is kept.
    """
    rows = chunks.select("company", "year", "chunk_id", "heading", F.posexplode(sentences(F.col("text"))).alias("position", "text"))
    once = first_per(rows, ["company", "year", "text"], ["chunk_id", "position"])
    return once.select(short_id(F.col("chunk_id"), F.col("position"), F.col("text")).alias("sentence_id"), "company", "year", "chunk_id", "heading", "text")


def axis_report(chunks: DataFrame, axes: DataFrame, model: Model, cache: str, dedup: Dedup = near_dedup, near_cosine: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Two tables of every axis at both levels: the yearly series of companies, and the quotes behind it.

    The series: axis, level, company, year, raw_topk_mean, k_used, n_chunks, zscore and, of chunks, carried_forward_frac: the
    share of a year's chunks that are close to one of the year before that has any. The quotes: axis, level, company, year, rank, text, heading,
    score. Chunks that repeat within a company count once, by ``dedup``; sentences are those of the chunks kept.
    """
    once = kept(embedded(kept(dedup(chunks, ["company"]), "chunks"), model, cache), "embedded")
    said = kept(embedded(kept(sentence_rows(once), "sentences"), model, cache), "embedded")
    by, series, quotes = ["axis", "company"], [], []
    for level, rows, key in (("chunk", once, "chunk_id"), ("sentence", said, "sentence_id")):
        scored = project(rows.select("company", "year", F.col(key).alias("id"), "heading", "text", "embedding"), axes)
        made = rollup.period_series(scored, by, "year", "score", "id").withColumn("level", F.lit(level))
        series.append(made if level == "sentence" else rollup.same_keys(made, rollup.carried_forward(once, ["company"], "year", "chunk_id", "embedding", near_cosine), ["company", "year"]))
        best = rollup.ranked(scored, [*by, "year"], "score", "id", rollup.TOP_K)
        quotes.append(best.select("axis", F.lit(level).alias("level"), "company", "year", "rank", "text", "heading", F.round("score", 4).alias("score")))
    both = series[0].unionByName(series[1], allowMissingColumns=True)
    return both.select("axis", "level", "company", "year", "raw_topk_mean", "k_used", "n_chunks", "zscore", "carried_forward_frac"), quotes[0].unionByName(quotes[1])


def stance_report(chunks: DataFrame, axes: DataFrame, control: DataFrame, model: Model, cache: str, wanted: DataFrame | None = None, dedup: Dedup = near_dedup) -> tuple[DataFrame, DataFrame]:
    """Two tables of a company's years: scores of two poles with registers, churn and control, and the evidence for them.

    ``chunks`` have a register (null: not classified) and the flag ``wanted`` of the language filter; those without it count in
    n_chunks_raw only. Texts that repeat within a year count once, by ``dedup``. ``axes`` hold inclusion and meritocracy; ``control``
    (company, year, raw_topk_mean) lies beside the series where it has the year. The evidence: kind, rank, text (its
    first 400 characters), heading, register and scores of the best chunks of either pole, the extremes of the stance,
    and as counter the most salient civilizational chunk, or else that of any register that runs counter.
    """
    by = ["company", "year"]
    raw = chunks.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n_chunks_raw"))
    once = embedded(kept(dedup(chunks.where("wanted"), by), "chunks"), model, cache)
    for axis in ("inclusion", "meritocracy"):
        once = project(once, axes.where(F.col("axis") == axis)).withColumnRenamed("score", axis).drop("axis")
    rows = kept(once.drop("embedding"), "scored").withColumns({"stance_diff": F.col("inclusion") - F.col("meritocracy"), "salience": F.greatest("inclusion", "meritocracy")})
    series = rollup.stance_series(rows, by, "inclusion", "meritocracy", "chunk_id").drop("stance_max_id", "stance_min_id")
    counts = rollup.label_counts(rows, by, "register", REGISTERS, "register_")
    for part in (raw, counts, rollup.text_churn(rows, ["company"], "year", "text")):
        series = rollup.same_keys(series, part, by)
    series = series.join(control.select(*by, F.col("raw_topk_mean").alias("control_raw_topk_mean")), by, "left")
    return series.withColumn("k_used", F.least("n_chunks", F.lit(rollup.TOP_K))), _evidence(rows, by)


def _evidence(rows: DataFrame, by: list[str]) -> DataFrame:
    scores = ["inclusion", "meritocracy", "stance_diff", "salience"]
    civil = (F.col("register") == "civilizational_mission").cast("int")
    counter = rows.where(F.col("register").isin(COUNTER_REGISTERS)).withColumn("__order", F.struct(civil, "salience"))
    kinds = [
        ("inclusion", rows.withColumn("__order", F.struct("inclusion")), rollup.TOP_K), ("meritocracy", rows.withColumn("__order", F.struct("meritocracy")), rollup.TOP_K),
        ("stance_max", rows.withColumn("__order", F.struct("stance_diff")), 1), ("stance_min", rows.withColumn("__order", F.struct(-F.col("stance_diff"))), 1), ("counter", counter, 1),
    ]
    found = [rollup.ranked(part, by, "__order", "chunk_id", k).withColumn("kind", F.lit(kind)).drop("__order") for kind, part, k in kinds]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(*by, "kind", "rank", F.left("text", F.lit(QUOTE_CHARS)).alias("text"), "heading", "register", *[F.round(c, 4).alias(c) for c in scores])
