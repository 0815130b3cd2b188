"""Evidence quotes: phrases over time, highlights with quotas, timelines, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.operators.dedup import first_per


def term_tracking(hits: DataFrame, term: str, period: str, score: str, text: str, tie: str, cut: int = 200, by: list[str] | None = None) -> DataFrame:
    """``by``, term, first_year, last_year, max_score, n_hits, example: the text of the best hit, cut to ``cut`` characters."""
    return hits.groupBy(*(by or []), F.col(term).alias("term")).agg(
        F.min(period).alias("first_year"), F.max(period).alias("last_year"), F.max(score).alias("max_score"), F.count(F.lit(1)).alias("n_hits"),
        F.substring(F.min_by(text, F.struct(-F.col(score), F.col(tie))), 1, cut).alias("example"),
    )


def found_terms(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows with each lower-cased match of ``pattern`` as ``term``."""
    return rows.withColumn("term", F.explode(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), F.lower)))


def high_scoring(sentences: DataFrame, by: list[str], text: str, score: str, threshold: float = 0.3) -> DataFrame:
    """sentence_id, ``by``, text, score: sentences that reach the threshold, each once in ``by`` with its best score; the id is made of the text."""
    best = sentences.where(F.col(score) >= threshold).groupBy(*by, text).agg(F.max(score).alias(score))
    return best.select(F.left(F.sha2(text, 256), F.lit(12)).alias("sentence_id"), *by, text, score)


def story(highlights: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: highlights, an array in the order of stance and pick, and lexicons, a map of each lexicon's terms in the order of their first year.

    Both tables are bounded by the quotas and pattern lists that made them.
    """
    quotes = F.array_sort(F.collect_list(F.struct("stance", "pick", *[c for c in highlights.columns if c not in ("stance", "pick")])))
    era = terms.groupBy("lexicon").agg(F.array_sort(F.collect_list(F.struct("first_year", *[c for c in terms.columns if c not in ("lexicon", "first_year")]))).alias("terms"))
    lexicons = era.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lexicon", "terms")))).alias("lexicons"))
    return highlights.agg(quotes.alias("highlights")).join(F.broadcast(lexicons), F.lit(True))


def quota_pick(rows: DataFrame, group: str, owner: str, score: str, tie: str, quota: int = 3) -> DataFrame:
    """Per group the best of each owner first, then the best of the rest, ``quota`` rows; ``pick`` is their order by score.

    Of more owners than the quota the best scores stay.
    """
    best = F.row_number().over(Window.partitionBy(group, owner).orderBy(F.desc(score), tie)) == 1
    flagged = rows.withColumn("__best", best.cast("int"))
    order = [F.desc("__best"), F.desc(score), F.col(tie)]
    kept = flagged.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= quota)
    return kept.withColumn("pick", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).drop("__best", "__n")


def distinct_prefix(rows: DataFrame, text: str, size: int, order: list[Column | str]) -> DataFrame:
    """The first row in ``order`` of each beginning of ``size`` characters."""
    return first_per(rows, [F.substring(text, 1, size)], order)


def first_and_last(rows: DataFrame, by: list[str], label: str, period: str, score: str, text: str, tie: str, most: int = 8, prefix: int = 80) -> DataFrame:
    """A timeline per ``by``: of each label the best quote of its first and of its last period, no text twice, ``most`` rows."""
    best = first_per(rows, [*by, label, period], [F.desc(score), tie])
    w = Window.partitionBy(*by, label)
    ends = best.withColumns({"__lo": F.min(period).over(w), "__hi": F.max(period).over(w)})
    ends = ends.where((F.col(period) == F.col("__lo")) | (F.col(period) == F.col("__hi"))).drop("__lo", "__hi")
    once = first_per(ends, [*by, F.substring(text, 1, prefix)], [period, label, tie])
    place = F.row_number().over(Window.partitionBy(*by).orderBy(period, label, tie))
    return once.withColumn("place", place).where(F.col("place") <= most)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of key and seed: the same rows on any cluster."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows: n // strata of each stratum by a hash of the key, topped up from the rest in the same order."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    buckets = rows.select(*strata).distinct().agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("__buckets"))
    placed = rows.withColumn("__h", h).withColumn("__n", F.row_number().over(Window.partitionBy(*strata).orderBy("__h", key)))
    quota = placed.join(F.broadcast(buckets), F.lit(True)).withColumn("__extra", (F.col("__n") > F.floor(F.lit(n) / F.col("__buckets"))).cast("int"))
    return quota.orderBy("__extra", "__h", key).limit(n).drop("__h", "__n", "__buckets", "__extra")
