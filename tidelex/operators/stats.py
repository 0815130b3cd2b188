"""Agreement, correlation and ranking statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """n and accuracy; null where there is nothing to compare."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def correlation(x: str, y: str, least: int = 3) -> Column:
    """An aggregate: Pearson's r, null for fewer than ``least`` pairs or where a side does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    n, sx, sy = F.count(a), F.stddev_pop(a), F.stddev_pop(b)
    return F.when((n >= least) & (sx > 0) & (sy > 0), F.try_divide(F.covar_pop(a, b), sx * sy))


def average_ranks(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """With rank_<c> for each column: ties share the mean of their places."""
    out = rows
    for c in columns:
        out = out.withColumn(f"rank_{c}", F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0)
    return out


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by``, n, spearman: null for fewer than three pairs or where a side does not vary."""
    r = average_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, [x, y])
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(f"rank_{x}", f"rank_{y}").alias("spearman"))


def p_value(r: float, n: int) -> float | None:
    """Two-sided p of a correlation over n pairs, by the t distribution; None where undefined."""
    if n < 3 or r is None or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    v = n - 2
    return _incomplete_beta(v / 2, 0.5, v / (v + r * r * v / (1 - r * r)))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


MOST_PAIRINGS = 100_000


def bradley_terry(judgments: DataFrame, iterations: int = 200) -> DataFrame:
    """player, strength from (a, b, winner) rows, by minorisation steps that add up to 1 each time.

    Wins and games are counted by Spark; the steps run over the table of players (tens) on the driver, and more than
    MOST_PAIRINGS different pairs of players are an error. A player without games gets 1e-9, one without wins 0.
    """
    spark = judgments.sparkSession
    pairings = judgments.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count()
    if pairings > MOST_PAIRINGS:
        raise ValueError(f"{pairings} pairs of players; the strengths are fitted on the driver, for {MOST_PAIRINGS} at most")
    games = judgments.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    wins = {r.winner: r.n for r in judgments.groupBy("winner").agg(F.count(F.lit(1)).alias("n")).collect()}
    players = sorted({p for r in games for p in (r.a, r.b)})
    if not players:
        return spark.createDataFrame([], "player int, strength double")
    p = {x: 1.0 / len(players) for x in players}
    for _ in range(iterations):
        new = {}
        for x in players:
            total = sum(r.n / (p[r.a] + p[r.b]) for r in games if x in (r.a, r.b) and p[r.a] + p[r.b] > 0)
            new[x] = wins.get(x, 0) / total if total > 0 else 1e-9
        size = sum(new.values())
        p = {x: v / size for x, v in new.items()} if size else new
    return spark.createDataFrame([(int(x), float(v)) for x, v in p.items()], "player int, strength double")


def ground_truth(series: DataFrame, by: list[str], period: str, value: str, expected: DataFrame, tolerance: int = 2) -> DataFrame:
    """Peak period against the expected one; null where nothing is expected."""
    peak = series.groupBy(*by).agg(F.min_by(period, F.struct(-F.col(value), F.col(period))).alias("peak"))
    return peak.join(expected, by, "left").withColumn("passed", F.abs(F.col("peak") - F.col("expected")) <= tolerance)
