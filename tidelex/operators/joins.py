"""Joins with stated sides, keys and tie-breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.storage import cut

#: Rows of a table that one broadcast may hold: at some 30 kB a row, 120 MB.
BLOCK_ROWS = 4096
#: n-grams that one broadcast may hold: at some 100 bytes, 20 MB.
BROADCAST_GRAMS = 200_000


def joined_in_blocks(rows: DataFrame, few: DataFrame, on: Column, most: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` joined with a table of any size on any condition, by broadcasts of at most ``most`` of its rows each.

    ``few`` is kept and counted first; beyond ``most`` rows it goes along in blocks, one join each.
    """
    few = cut(few)
    if few.count() <= most:
        return rows.join(F.broadcast(few), on)
    place = F.monotonically_increasing_id()  # counts up within a partition, so a block never holds over ``most`` rows
    blocks = few.withColumn("__block", place - F.pmod(F.pmod(place, F.lit(1 << 33)), F.lit(most)))
    found = [r["__block"] for r in blocks.select("__block").distinct().collect()]
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(blocks.where(F.col("__block") == b).drop("__block")), on) for b in sorted(found)])


def with_labels(rows: DataFrame, labels: DataFrame, on: str, default: str | None = None, label: str = "label") -> DataFrame:
    """Every row with its label, or null (or ``default``) where there is none."""
    out = rows.join(labels.select(on, label), on, "left")
    return out if default is None else out.withColumn(label, F.coalesce(label, F.lit(default)))


def overridden(predicted: DataFrame, overrides: DataFrame, on: str, label: str, allowed: list[str]) -> DataFrame:
    """on, label, source: an override wins over a prediction and may stand alone; an unknown one is an error."""
    checked = overrides.select(on, F.when(F.col(label).isin(allowed), F.col(label)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))).alias("__new"))
    both = predicted.select(on, label).join(checked, on, "full")
    return both.select(on, F.coalesce("__new", label).alias(label), F.when(F.col("__new").isNotNull(), "override").otherwise("predicted").alias("source"))


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_at: Column, right_at: Column, fields: list[str], tie: list[str]) -> DataFrame:
    """Per left row of a shared key the right row at the least distance, ties by ``tie``, in the column ``nearest``.

    Both sides are merged in one order per key, where each left row sees the last right row before it and the first one
    behind; no pairs are made. Left rows without place, key or any right row of their key are left out.
    """
    rows = right.select(*on, right_at.alias("__at"), F.struct(*fields).alias("__row"), F.struct(*tie).alias("__tie")).where(F.col("__at").isNotNull())
    once = rows.groupBy(*on, "__at").agg(F.min_by(F.struct("__at", "__tie", "__row"), "__tie").alias("__there"))
    mine = left.select(*on, left_at.alias("__at"), F.struct(*left.columns).alias("__me")).where(F.col("__at").isNotNull())
    both = mine.unionByName(once, allowMissingColumns=True).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]))
    w = Window.partitionBy(*on).orderBy("__at", F.col("__there").isNull())  # a right row at the same place comes before
    before = F.last("__there", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first("__there", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumns({"__before": before, "__behind": behind}).where("__me is not null and (__before is not null or __behind is not null)")
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("__at") - F.col(f"{c}.__at")).alias("away"), F.col(f"{c}.__tie").alias("tie"), F.col(f"{c}.__row").alias("row")))
    return seen.select("__me.*", F.array_min(F.filter(F.array(away("__before"), away("__behind")), lambda x: x.isNotNull()))["row"].alias("nearest"))


def within(points: DataFrame, at: str, spans: DataFrame, first: str, last: str) -> DataFrame:
    """Points with every span that holds them, ends (integers) included.

    A span lies in one or two bins of the least power of two that is longer than it; a point is looked up once for
    each of the lengths, 64 at most, that a first pass finds. So neither side multiplies with the length of the spans.
    """
    bits = F.length(F.bin(F.col(last).cast("long") - F.col(first).cast("long")))
    sized = spans.where(F.col(first) <= F.col(last)).withColumn("__bits", bits)
    known = sorted(r["__bits"] for r in sized.select("__bits").distinct().collect())
    lowest, highest = (F.expr(f"shiftright(cast(`{c}` as bigint), __bits)") for c in (first, last))
    bins = sized.withColumn("__bin", F.explode(F.sequence(lowest, highest)))
    asked = points.withColumn("__bits", F.explode(F.array(*[F.lit(b) for b in known]) if known else F.array().cast("array<int>")))
    asked = asked.withColumn("__bin", F.expr(f"shiftright(cast(`{at}` as bigint), __bits)"))
    return asked.join(bins, ["__bits", "__bin"]).where(F.col(at).between(F.col(first), F.col(last))).drop("__bits", "__bin")


def matching_patterns(rows: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """Rows with each (id, pattern) whose regular expression is found in the text."""
    return joined_in_blocks(rows, patterns, F.rlike(F.col(text), F.col("pattern"))).drop("pattern")


def shares_ngram(rows: DataFrame, key: str, grams: str, other: DataFrame, other_grams: str) -> DataFrame:
    """Distinct keys of rows that share an n-gram with ``other``.

    The other side's n-grams are counted first; up to BROADCAST_GRAMS of them go along with the tasks, so that only
    keys are shuffled, more are met in a shuffle of both sides.
    """
    theirs = cut(other.select(F.explode(other_grams).alias("gram")).distinct())
    if theirs.count() <= BROADCAST_GRAMS:
        theirs = F.broadcast(theirs)
    return rows.select(key, F.explode(grams).alias("gram")).join(theirs, "gram", "left_semi").select(key).distinct()
