"""Period series: adaptive top-k, z-scores, presence, churn, carried-forward shares, trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.operators.cosine import close_to_any

TOP_K = 5
PRESENCE = 0.25


def ranked(rows: DataFrame, by: list[str], score: str, tie: str, k: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` within ``by``, highest score first, ties to the smaller ``tie``; only ranks up to k."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))
    return out if k is None else out.where(F.col("rank") <= k)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two aggregates of one table side by side; null keys meet."""
    other = b.select(*[F.col(c).alias(f"__{c}") if c in keys else c for c in b.columns])
    return a.join(other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])).drop(*[f"__{c}" for c in keys])


def topk_mean(rows: DataFrame, by: list[str], score: str, tie: str, k: int = TOP_K) -> DataFrame:
    """``by``, raw_topk_mean and k_used: the mean of the k best, or of all where there are fewer. No more than k rows of a group leave a task."""
    return ranked(rows, by, score, tie, k).groupBy(*by).agg(F.avg(score).alias("raw_topk_mean"), F.count(F.lit(1)).cast("int").alias("k_used"))


def period_series(rows: DataFrame, by: list[str], period: str, score: str, tie: str, k: int = TOP_K) -> DataFrame:
    """Top-k mean, k_used and n_chunks per ``by`` and ``period``, with a z-score over the periods of each ``by``."""
    keys = [*by, period]
    best, n = topk_mean(rows, keys, score, tie, k), rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    return with_zscore(same_keys(best, n, keys), by, "raw_topk_mean")


def with_zscore(series: DataFrame, by: list[str], value: str, name: str = "zscore") -> DataFrame:
    """Distance to the group's mean in population standard deviations; 0 where all are equal."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return series.withColumn(name, F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(value) - F.avg(value).over(w), sd)))


def presence(score: str, threshold: float = PRESENCE) -> Column:
    """An aggregate: the share of rows whose score reaches the threshold."""
    return F.avg((F.col(score) >= threshold).cast("double"))


def best_row(fields: list[str], score: str, tie: str, lowest: bool = False) -> Column:
    """An aggregate: the row with the highest (or lowest) score, ties to the smaller ``tie``; rows of null score last."""
    value = -F.col(score) if not lowest else F.col(score)
    return F.min_by(F.struct(*fields), F.when(F.col(score).isNotNull(), F.struct(value.alias("v"), F.col(tie).alias("t"))))


def stance_series(rows: DataFrame, by: list[str], inclusion: str, merit: str, tie: str, k: int = TOP_K) -> DataFrame:
    """Mean, top-k mean, maximum and presence of two scores, and extremes of their difference, per group."""
    scored = rows.withColumns({"stance": F.col(inclusion) - F.col(merit), "salience": F.greatest(inclusion, merit)})
    out = scored.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("n_chunks"),
        *[f for c in (inclusion, merit) for f in (F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), presence(c).alias(f"{c}_present"))],
        F.max("stance").alias("stance_max"),
        F.min("stance").alias("stance_min"),
        F.avg("stance").alias("stance_mean"),
        best_row([tie], "stance", tie)[tie].alias("stance_max_id"),
        best_row([tie], "stance", tie, lowest=True)[tie].alias("stance_min_id"),
    )
    for c in (inclusion, merit, "salience"):
        out = same_keys(out, topk_mean(scored, by, c, tie, k).select(*by, F.col("raw_topk_mean").alias(f"{c}_topk_mean")), by)
    return out


def bipolar_series(rows: DataFrame, by: list[str], score: str, tie: str, k: int = TOP_K) -> DataFrame:
    """Top-k mean, mean, extremes, and salience: the mean size of the k best scores."""
    best = ranked(rows, by, score, tie, k).groupBy(*by).agg(F.avg(score).alias("topk_mean"), F.count(F.lit(1)).cast("int").alias("k_used"), F.avg(F.abs(score)).alias("salience"))
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n_chunks"), F.avg(score).alias("mean"), F.max(score).alias("max"), F.min(score).alias("min"))
    return same_keys(whole, best, by)


def label_counts(rows: DataFrame, by: list[str], label: str, labels: list[str], prefix: str = "") -> DataFrame:
    """A column per label, 0 where it does not occur; null labels count nowhere."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(label) == x).alias(f"{prefix}{x}") for x in labels])


def label_shares(counts: DataFrame, labels: list[str], total: str, groups: dict[str, list[str]], prefix: str = "") -> DataFrame:
    """Shares of groups of labels in ``total``; 0 where the total is 0."""
    share = lambda names: F.coalesce(F.try_divide(sum((F.col(f"{prefix}{x}") for x in names), F.lit(0)), F.col(total)).cast("double"), F.lit(0.0))
    return counts.withColumns({k: share(v) for k, v in groups.items()})


def dominant_label(counts: DataFrame, by: list[str], labels: list[str], prefix: str, least: float = 0.35, absent: str = "absent") -> DataFrame:
    """The label with the largest share of all but ``absent`` over all periods, if it reaches ``least``; ties to the earlier label."""
    sums = counts.groupBy(*by).agg(*[F.sum(f"{prefix}{x}").alias(x) for x in labels if x != absent])
    kept = [x for x in labels if x != absent]
    total = sum((F.col(x) for x in kept), F.lit(0))
    rows = F.array(*[F.struct(F.try_divide(F.col(x), total).cast("double").alias("share"), F.lit(-i).alias("place"), F.lit(x).alias("label")) for i, x in enumerate(kept)])
    best = F.array_max(rows)
    return sums.withColumn("best", best).select(*by, F.when(F.col("best.share") >= least, F.col("best.label")).alias("dominant"), F.coalesce("best.share", F.lit(0.0)).alias("share"))


def cumulative_stack(counts: DataFrame, by: list[str], labels: list[str], prefix: str = "") -> DataFrame:
    """``by``, label, value, lower and upper: the labels stacked in their order."""
    long = counts.select(*by, F.posexplode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"{prefix}{x}").alias("value")) for x in labels])).alias("place", "item"))
    upper = F.sum("item.value").over(Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return long.select(*by, "item.label", "item.value", (upper - F.col("item.value")).alias("lower"), upper.alias("upper"))


def text_churn(rows: DataFrame, by: list[str], period: str, text: str) -> DataFrame:
    """``by``, period, n_unique_texts, text_churn: the share of a period's texts that the period before it lacks.

    The period before is the latest with rows; the first period's churn is 1. Texts are compared as rows, so no
    period's set of texts is ever gathered in one place.
    """
    texts = rows.select(*by, period, text).distinct()
    periods = texts.groupBy(*by, period).agg(F.count(F.lit(1)).alias("n_unique_texts"))
    before = periods.withColumn("before", F.lag(period).over(Window.partitionBy(*by).orderBy(period)))
    now = texts.join(before.select(*by, period, "before"), [*by, period])
    old = texts.select(*by, F.col(period).alias("before"), text, F.lit(1).alias("kept"))
    kept = now.join(old, [*by, "before", text], "left").groupBy(*by, period).agg(F.sum(F.coalesce("kept", F.lit(0))).alias("kept"), F.count(F.lit(1)).alias("n_unique_texts"))
    return kept.select(*by, period, "n_unique_texts", (1 - F.col("kept") / F.col("n_unique_texts")).alias("text_churn"))


def carried_forward(rows: DataFrame, by: list[str], period: str, key: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """``by``, period, carried_forward_frac: the share of vectors with a cosine of ``threshold`` or more to one of the period before.

    The first period of a group is null. Rows meet those of the period before only, in blocks; a vector that is null or
    zero is close to none.
    """
    keys = [*by, period]
    before = rows.select(*keys).distinct().withColumn("before", F.lag(period).over(Window.partitionBy(*by).orderBy(period)))
    now = rows.join(before, keys)
    old = rows.select(*by, F.col(period).alias("before"), key, vector)
    close = close_to_any(now.select(*by, "before", key, vector), old, [*by, "before"], key, vector, threshold).withColumn("hit", F.lit(1))
    close = close.join(before.select(*keys, "before"), [*by, "before"]).select(*keys, key, "hit")
    return now.join(close, [*keys, key], "left").groupBy(*keys).agg(F.when(F.first("before").isNotNull(), F.avg(F.coalesce("hit", F.lit(0)))).alias("carried_forward_frac"))


def peak_and_latest(series: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """The period of the highest value (ties to the earlier), the latest one, and their values."""
    return series.groupBy(*by).agg(
        F.min_by(period, F.struct(-F.col(value), F.col(period))).alias("peak_period"), F.max(value).alias("peak_value"), F.max(period).alias("latest_period"), F.max_by(value, period).alias("latest_value")
    )


def first_substantive(series: DataFrame, by: list[str], period: str, value: str, least: float) -> DataFrame:
    """``by``, first_year: the first period whose value reaches ``least``, else the first of all."""
    return series.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col(value) >= least, F.col(period))), F.min(period)).alias("first_year"))


def largest_drop(series: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """The period of the largest fall from the one before it, at or after the peak; null where nothing falls."""
    w = Window.partitionBy(*by)
    steps = series.withColumns({"drop": F.lag(value).over(w.orderBy(period)) - F.col(value), "peak": F.min_by(period, F.struct(-F.col(value), F.col(period))).over(w)})
    after = F.when((F.col(period) >= F.col("peak")) & (F.col("drop") > 0), F.struct(-F.col("drop"), F.col(period)))
    return steps.groupBy(*by).agg(F.min_by(period, after).alias("retraction_period"), F.max(F.when((F.col(period) >= F.col("peak")) & (F.col("drop") > 0), F.col("drop"))).alias("drop"))


def trend(series: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """at_high, steady, declined or declined_sharply: the latest value against the peak."""
    p = peak_and_latest(series, by, period, value)
    d = F.col("latest_value") - F.col("peak_value")
    return p.withColumn("trend", F.when(F.col("peak_period") == F.col("latest_period"), "at_high").when(d > -0.25, "steady").when(d > -1, "declined").otherwise("declined_sharply"))


def group_mean(series: DataFrame, period: str, value: str) -> DataFrame:
    """The mean over groups per period; nulls do not count."""
    return series.groupBy(period).agg(F.avg(value).alias("industry_mean"), F.count(value).alias("n_groups"))


def bands(value: Column) -> Column:
    """Five bands of a share, as a heatmap colours them; null stays null."""
    return F.when(value <= 0.01, 0).when(value < 0.15, 1).when(value < 0.3, 2).when(value < 0.5, 3).when(value.isNotNull(), 4)
