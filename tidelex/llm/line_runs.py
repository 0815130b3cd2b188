"""Removal of repeated runs of lines, by prefix doubling over the corpus as a sequence of line ids.

Every line starts a suffix: the ids of the lines from there to the end of its document. Prefix doubling names the
suffixes by their first 1, 2, 4, ... lines: two neighbouring names of one level give the name of the next, a 128-bit
hash of both. Equal names are equal lines; which of two suffixes comes first in an order of the lines is never asked,
so the names are not sorted into ranks. Only suffixes that share their name go on, as one that is alone at some depth
has no longer common prefix with any other; doubling ends when none is left. The levels that remain answer longest
common prefixes: from the deepest level down, equal names mean so many lines more in common.

Suffixes with a common prefix of ``min_lines`` lines or more are an LCP interval, the occurrences of one repeated run.
The first one stays. Of every other occurrence that does not overlap it, the longest common prefix with the first one
gives the maximal run, and these later copies are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.llm.common import cut, partitions_of, text_or_empty

AT = ["doc_id", "text_key", "line"]
DOC = ["doc_id", "text_key"]


#: Levels of the longest common prefixes that are joined in one job.
LEVELS_A_JOB = 4


def _tied(rows: DataFrame) -> DataFrame:
    """Of rows with a name, those that share it."""
    names = rows.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id1", "id2")
    return rows.join(names, ["id1", "id2"], "left_semi")


def _with_ahead(rows: DataFrame, step: int) -> DataFrame:
    """Rows with id1 and id2 of the place ``step`` lines ahead as ahead1 and ahead2, where the document has it."""
    w = Window.partitionBy(*DOC).orderBy("line").rangeBetween(step, step)
    return rows.withColumns({"ahead1": F.first("id1").over(w), "ahead2": F.first("id2").over(w)}).where("ahead1 is not null")


def _joined_name(level: int) -> list[Column]:
    """id1 and id2 of the two names in a row."""
    return [F.xxhash64("id1", "ahead1").alias("id1"), F.xxhash64(F.lit(level), "id2", "ahead2").alias("id2")]


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line (from 0), id1, id2: every line with a 128-bit id of its content."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_key"), F.posexplode(F.split(text_or_empty(), "\n")).alias("line", "body"))
    return rows.select(*AT, F.xxhash64("body").alias("id1"), F.xxhash64(F.lit("line"), "body").alias("id2"))


def suffix_levels(docs: DataFrame, partitions: int) -> list[DataFrame]:
    """Per level k (doc_id, text_key, line, id1, id2) of the suffixes that share their first 2 ** k lines with another one.

    Equal ids of a level are equal first 2 ** k lines. The last level has no rows. Documents are dealt to ``partitions``.
    """
    levels = [cut(_tied(lines_of(docs)).select(*AT, "id1", "id2").repartition(partitions, *DOC).dropDuplicates(AT))]
    while not levels[-1].isEmpty():
        pairs = _with_ahead(levels[-1], 1 << (len(levels) - 1))
        levels.append(cut(_tied(pairs.select(*AT, *_joined_name(len(levels)))).select(*AT, "id1", "id2")))
    return levels


def later_copies(levels: list[DataFrame], min_lines: int) -> DataFrame:
    """doc_id, text_key, line, first: occurrences of ``min_lines`` lines that also start, without overlap, at the earlier place ``first``."""
    k = min_lines.bit_length() - 1
    if k >= len(levels):
        return levels[-1].select(*AT, F.struct(*AT).alias("first"))
    spots, step = levels[k], min_lines - (1 << k)  # the two names overlap where min_lines is no power of two
    if step:
        spots = _with_ahead(spots, step).select(*AT, *_joined_name(-1))
    first = spots.groupBy("id1", "id2").agg(F.min(F.struct(*AT)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))
    return spots.join(first, ["id1", "id2"]).where(~own | (F.col("line") - F.col("first.line") >= min_lines)).select(*AT, "first")


def with_lcp(pairs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``pairs`` (doc_id, text_key, line, first, ...) with ``lcp``: how many lines the suffixes at both places have in common."""
    own, out = pairs.columns, cut(pairs.withColumn("lcp", F.lit(0)))
    for k in reversed(range(len(levels) - 1)):
        mine = out.select("*", F.struct("doc_id", "text_key", (F.col("line") + F.col("lcp")).alias("line")).alias("p"), F.struct("first.doc_id", "first.text_key", (F.col("first.line") + F.col("lcp")).alias("line")).alias("q"))
        a, b = (levels[k].select(F.struct(*AT).alias(c), F.struct("id1", "id2").alias(f"name_{c}")) for c in "pq")
        mine = mine.join(a, mine["p"].eqNullSafe(a["p"]), "left").drop("p").join(b, mine["q"].eqNullSafe(b["q"]), "left").drop("q")
        more = F.when(F.col("name_p") == F.col("name_q"), 1 << k).otherwise(0)
        out = mine.select(*own, (F.col("lcp") + more).alias("lcp"))
        out = out if k % LEVELS_A_JOB else cut(out)
    return out


def repeated_runs(docs: DataFrame, min_lines: int = 3) -> DataFrame:
    """doc_id, text_key, start, length, first_doc, first_line: maximal runs that are later copies of an earlier run.

    A run starts where the line before it is not copied from the line before its first occurrence. Its length is the
    longest common prefix with that occurrence, but not beyond the copies themselves, as a run that goes on into its
    own beginning overlaps what must stay. Runs of one document may overlap.
    """
    levels = suffix_levels(docs, max(8, partitions_of(docs)))
    copies = cut(later_copies(levels, min_lines))
    w = Window.partitionBy(*DOC, F.col("first.doc_id"), F.col("first.text_key"), F.col("line") - F.col("first.line")).orderBy("line")
    rows = copies.withColumn("island", F.col("line") - F.row_number().over(w))
    by = [*DOC, F.col("first.doc_id").alias("first_doc"), F.col("first.text_key").alias("first_key"), (F.col("line") - F.col("first.line")).alias("far"), "island"]
    starts = rows.groupBy(*by).agg(F.min("line").alias("line"), F.count(F.lit(1)).cast("int").alias("n"), F.min("first").alias("first"))
    found = with_lcp(starts.select(*AT, "first", "n"), levels)
    length = F.least(F.col("lcp"), F.col("n") + (min_lines - 1))
    return found.select(*DOC, F.col("line").alias("start"), length.alias("length"), F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"))


def remove_repeated_runs(docs: DataFrame, min_lines: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed, kept: each row's text without the later copies of runs of ``min_lines`` lines or more.

    Lines end at line feeds and are compared byte by byte; blank lines count. Documents come in the order of doc_id,
    a null one first, and two texts under one doc_id in the order of a hash of the text; rows that repeat doc_id and
    text are one document and are all returned. A run may repeat within one document; an occurrence that overlaps the
    first one stays, so the first one stays whole. A null text counts as empty: one blank line. Long texts are many
    lines. An empty table gives no rows. Only doc_id and text are read, so other columns may have any names.
    """
    runs = repeated_runs(docs, min_lines)
    gone = runs.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("line")).distinct()
    island = F.col("line") - F.row_number().over(Window.partitionBy(*DOC).orderBy("line"))
    joined = gone.withColumn("island", island).groupBy(*DOC, "island").agg(F.min("line").alias("start"), F.max("line").alias("end"))
    runs = joined.groupBy(*DOC).agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    mine = mine.withColumn("text_key", F.xxhash64("text")).alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    found = mine.join(runs.alias("b"), same, "left").select("a.doc_id", F.split("a.text", "\n").alias("lines"), "b.gone")
    inside = lambda i: F.exists("gone", lambda r: i.between(r["start"], r["end"]))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~inside(i)))
    n_lines = F.size("lines").cast("long")
    return found.select("doc_id", n_lines.alias("n_lines"), kept.alias("left")).select("doc_id", "n_lines", (F.col("n_lines") - F.size("left")).cast("long").alias("n_removed"), F.array_join("left", "\n").alias("kept"))
