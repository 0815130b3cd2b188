"""Deduplication that keeps a stated row."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.operators.text_ratio import close_pairs
from tidelex.storage import cut


def first_per(rows: DataFrame, by: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each ``by`` in ``order``, which should be total."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def unseen(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key ``known`` lacks."""
    return rows.join(known.select(*on), on, "left_anti")


def upserted(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """All of ``new``, and of ``old`` what ``new`` does not replace."""
    return new.unionByName(unseen(old, new, on))


def merged_captures(known: DataFrame, found: DataFrame, url: str = "original", ts: str = "timestamp", digest: str = "digest") -> DataFrame:
    """``known`` and of ``found`` the rows that are new by (url, timestamp) and by digest, the first of each digest."""
    new = unseen(unseen(found, known, [url, ts]), known, [digest])
    return known.unionByName(first_per(new, [digest], [ts, url]))


#: Texts, and characters, of a block of a large group; two blocks meet in one task.
BLOCK_ROWS, BLOCK_CHARS = 16_384, 16_000_000


def _close_pairs(exact: DataFrame, text: str, order: str, threshold: float) -> DataFrame:
    """early, late: rows of one scope at ``threshold`` of similarity or more, the longer (ties by ``order``) first.

    Lengths of close texts lie in one band or in neighbours, so a text goes to its own band and the next one. A group of
    more than a block's texts is dealt to blocks, which meet two by two; a block's texts meet each other where it meets the
    next one (the last block: the first). Only close pairs leave a task.
    """
    width = math.log((2 - threshold) / threshold) * 1.001 + 1e-9
    bodies = exact.select(F.col("__row").alias("row"), F.col("__scope").alias("scope"), F.col(order).cast("string").alias("at"), F.length(text).alias("size"), F.col(text).alias("body"))
    bodies = bodies.withColumn("band", F.floor(F.log(F.greatest("size", F.lit(1))) / width))
    sizes = bodies.select("scope", "size", F.explode(F.array("band", F.col("band") + 1)).alias("band")).groupBy("scope", "band").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_CHARS), F.lit(1)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")
    )
    there = bodies.withColumn("own", F.col("band")).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    there = there.join(sizes.where("n > 1"), ["scope", "band"]).withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (k != F.col("block")) | (F.col("blocks") == 1))
    there = there.withColumn("other", F.explode(others))
    tiles = there.select("scope", "band", "blocks", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", (F.col("own") == F.col("band")).alias("early"), "row", "at", "size", "body")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        lo, hi, blocks = (k.as_py() for k in key[2:])
        rows, block, early = (group[c].to_numpy() for c in ("row", "block", "early"))
        place = sorted(range(len(rows)), key=lambda i: (-size[i], at[i], rows[i])) if (size := group["size"].to_pylist()) and (at := group["at"].to_pylist()) else []
        rank = np.empty(len(rows), np.int64)
        rank[place] = np.arange(len(rows))
        within = {k for k in (lo, hi) if (k + 1) % blocks in (lo, hi)}  # blocks whose own pairs are compared here
        meet = lambda i, j: np.ones(len(j), bool) if block[i] in within else block[j] != block[i]
        pairs = np.fromiter((x for pair in close_pairs(group["body"].to_pylist(), early, rank, meet, threshold) for x in pair), np.int64).reshape(-1, 2)
        return pa.table({"early": rows[pairs[:, 0]], "late": rows[pairs[:, 1]]})

    return tiles.groupBy("scope", "band", "lo", "hi", "blocks").applyInArrow(compare, "early long, late long")


def near_duplicates_removed(rows: DataFrame, scope: list[str], text: str, order: str, threshold: float = 0.92) -> DataFrame:
    """Greedy near-duplicate removal within each ``scope``, longest text first (ties by ``order``).

    A row stays if it is below ``threshold`` of similarity to every row kept before it. The close pairs are found in
    tasks; then rows without an undecided row before them stay and their later neighbours go, until no pair is left.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be above 0 and at most 1, not {threshold!r}")
    once = first_per(rows.where(F.col(text).isNotNull()), [*scope, text], [order])
    exact = cut(once.withColumns({"__row": F.monotonically_increasing_id(), "__scope": F.to_json(F.struct(*scope))}))
    edges = cut(_close_pairs(exact, text, order, threshold))
    gone = []
    while not edges.isEmpty():
        first = edges.join(edges.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
        gone.append(cut(first.select("late").distinct()))
        edges = edges.join(gone[-1], "late", "left_anti")
        edges = cut(edges.join(gone[-1].select(F.col("late").alias("early")), "early", "left_anti"))
    for dropped in gone:
        exact = exact.join(dropped.select(F.col("late").alias("__row")), "__row", "left_anti")
    return exact.select(*rows.columns)


def similarity(a: str, b: str) -> Column:
    """Ratcliff-Obershelp ratio of two text columns; the order of the two matters."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    ratio.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratio, "double")(a, b)
