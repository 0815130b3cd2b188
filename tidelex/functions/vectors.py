"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.text import let
from tidelex.operators.joins import joined_in_blocks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_vector(vectors: DataFrame, column: str, by: list[str]) -> DataFrame:
    """``by`` and ``mean`` array<double>: the mean of each component. Partial sums per component before the shuffle."""
    parts = vectors.select(*by, F.posexplode(column).alias("i", "x"))
    means = parts.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("i", "x")))
    return (means.groupBy(*by) if by else means.groupBy()).agg(F.transform(rows, lambda r: r["x"]).alias("mean"))


def build_axes(poles: DataFrame, drop: Column | None = None) -> DataFrame:
    """axis, single_pole, vector: mean of unit vectors of pole ``a`` less that of pole ``b``, to unit length.

    ``poles``: axis, pole ("a" or "b"), embedding. Without a pole b the mean of pole a alone makes the axis. ``drop``
    marks rows left out, for leave-one-out variants.
    """
    kept = poles if drop is None else poles.where(~drop)
    means = mean_vector(kept.select("axis", "pole", unit(F.col("embedding")).alias("u")), "u", ["axis", "pole"])
    sides = means.groupBy("axis").agg(F.max(F.when(F.col("pole") == "a", F.col("mean"))).alias("a"), F.max(F.when(F.col("pole") == "b", F.col("mean"))).alias("b"))
    raw = F.when(F.col("b").isNull(), F.col("a")).otherwise(F.zip_with("a", "b", lambda x, y: x - y))
    return sides.select("axis", F.col("b").isNull().alias("single_pole"), unit(raw).alias("vector"))


def along(v: Column, axis: Column) -> Column:
    """The unit vector's component along the axis; 0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(v, axis), norm(v)), F.lit(0.0))


def project(vectors: DataFrame, axes: DataFrame, column: str = "embedding") -> DataFrame:
    """Every vector with every axis and ``score``: the unit vector's component along the axis."""
    scored = joined_in_blocks(vectors, axes.select("axis", "vector"), F.lit(True))
    return scored.withColumn("score", along(F.col(column), F.col("vector"))).drop("vector")
