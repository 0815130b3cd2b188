"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.storage import checkpoint_dir, cut, kept, scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where the frame has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def first_rows(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` first rows per key; Spark cuts each task's rows to ``n`` a key before it shuffles them."""
    (at,) = unused(df, "__at")
    return df.withColumn(at, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(at) <= n).drop(at)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions_of(df: DataFrame) -> int:
    """How many input splits the frame has: a measure of its size that needs no pass over it."""
    return max(1, df.rdd.getNumPartitions())
