"""Agreement, correlations, joins of series, and period aggregates of orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.catalog import query
from tidelex.operators import joins, rollup, stats
from tidelex.operators.dedup import upserted
from tidelex.plans.bindings import table


#: The players.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand labels (quality) with a prediction by length, as a case for agreement reports."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    predicted = F.when(F.col("n_chars") >= 800, "long").otherwise("short")
    return labels.join(docs, "doc_id").select("doc_id", F.when(F.col("quality") == 1, "long").otherwise("short").alias("truth"), predicted.alias("predicted"))


_JUDGED = "WITH j AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'long' ELSE 'short' END AS truth, CASE WHEN n_chars >= 800 THEN 'long' ELSE 'short' END AS predicted FROM labels JOIN documents USING (doc_id))"


@query(_JUDGED + "SELECT truth, predicted, count(*) AS n FROM j GROUP BY truth, predicted")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion(_judged(spark, sf_dir), "truth", "predicted")


@query(_JUDGED + "SELECT count(*) AS n, round(avg((truth = predicted)::INT), 3) AS accuracy FROM j")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.accuracy(_judged(spark, sf_dir), "truth", "predicted").withColumn("accuracy", F.round("accuracy", 3))


@query(_JUDGED + "SELECT doc_id, truth, predicted FROM j WHERE truth <> predicted")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("truth <> predicted")


@query("SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic = 0 THEN 'clean' END, 'unknown') AS label FROM documents LEFT JOIN labels USING (doc_id)")
def labelled_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("label"))
    return joins.with_labels(table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id", "unknown")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental run has left to classify."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
    WITH p AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label FROM labels), o AS (SELECT doc_id, 'fair' AS label FROM documents WHERE doc_id % 7 = 0)
    SELECT doc_id, coalesce(o.label, p.label) AS label, CASE WHEN o.label IS NOT NULL THEN 'override' ELSE 'predicted' END AS source FROM p FULL JOIN o USING (doc_id)
""")
def overridden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
    overrides = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select("doc_id", F.lit("fair").alias("label"))
    return joins.overridden(predicted, overrides, "doc_id", "label", ["good", "fair", "poor"])


@query("""
    SELECT doc_id, 'new' AS label FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT doc_id, 'old' FROM labels WHERE doc_id % 5 <> 0
""")
def upserted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", F.lit("old").alias("label"))
    return upserted(old, table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("label")), ["doc_id"])


_MONTHS = """
    WITH o AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::INT AS period, avg(o_totalprice) AS price, count(*)::DOUBLE AS orders FROM orders GROUP BY 1),
    l AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate))::INT AS period, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1),
    b AS (SELECT period, price, orders, quantity FROM o JOIN l USING (period))
"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = lambda c: (F.year(c) * 12 + F.month(c)).cast("int").alias("period")
    o = table(spark, sf_dir, "orders").groupBy(period("o_orderdate")).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).cast("double").alias("orders"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(period("l_shipdate")).agg(F.avg("l_quantity").alias("quantity"))
    return o.join(shipped, "period")


@query(_MONTHS + "SELECT count(*) AS n, round(corr(price, quantity), 6) AS r, abs(corr(price, quantity)) < 0.5 AS decoupled FROM b")
def series_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's r of two monthly series, decoupled below 0.5."""
    out = _monthly(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), stats.correlation("price", "quantity").alias("c"))
    return out.select("n", F.round("c", 6).alias("r"), (F.abs("c") < 0.5).alias("decoupled"))


@query(_MONTHS + """
    , k AS (SELECT rank() OVER (ORDER BY orders) + (count(*) OVER (PARTITION BY orders) - 1) / 2.0 AS a, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0 AS b FROM b)
    SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM k
""")
def series_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.spearman(_monthly(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], "orders", "quantity")
    return out.select("n", F.round("spearman", 6).alias("spearman"))


@query(_MONTHS + ", z AS (SELECT period, (price - avg(price) OVER ()) / stddev_pop(price) OVER () AS z FROM b) SELECT arg_max(period, z) AS peak, 23940 AS expected, abs(arg_max(period, z) - 23940) <= 2 AS passed FROM z")
def expected_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month of the highest price against an expected one, two months either way."""
    s = rollup.with_zscore(_monthly(spark, sf_dir).withColumn("name", F.lit("price")), ["name"], "price")
    expected = spark.range(1).select(F.lit("price").alias("name"), F.lit(23940).alias("expected"))
    return stats.ground_truth(s, ["name"], "period", "zscore", expected).select("peak", "expected", "passed")


@query("WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders) SELECT a.y AS a, b.y AS b FROM y a JOIN y b ON a.y < b.y")
def year_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of years in order, as a tournament draws them."""
    y = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("a")).distinct()
    return y.join(y.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))


@query()
def preference_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry strengths of market segments, of which the customer with the higher balance wins a comparison."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.array_position(F.array(*[F.lit(x) for x in SEGMENTS]), F.col("c_mktsegment")).cast("int").alias("player")).where("player > 0")
    other = c.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("player").alias("b"), F.col("c_acctbal").alias("bal_b"))
    games = c.join(other, "c_custkey").where(F.col("player") != F.col("b"))
    return stats.bradley_terry(games.select(F.col("player").alias("a"), "b", F.when(F.col("c_acctbal") >= F.col("bal_b"), F.col("player")).otherwise(F.col("b")).alias("winner")))


@query("""
    WITH spans AS (SELECT l_orderkey, l_linenumber, (year(l_shipdate))::INT AS first, (year(l_shipdate) + 1)::INT AS last FROM lineitem), years AS (SELECT unnest([1995, 1997]) AS y)
    SELECT y, l_orderkey, l_linenumber FROM years JOIN spans ON y BETWEEN first AND last
""")
def active_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: spans that are active in a selected year."""
    items = table(spark, sf_dir, "lineitem")
    spans = items.select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("first"), (F.year("l_shipdate") + 1).alias("last"))
    years = spark.range(2).select(F.when(F.col("id") == 0, 1995).otherwise(1997).alias("y"))
    return joins.within(years, "y", spans, "first", "last").select("y", "l_orderkey", "l_linenumber")


@query("""
    WITH p AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, event_id AS near_id, floor(epoch(ts))::BIGINT AS u FROM events WHERE event_type = 'view')
    SELECT p.event_id, arg_min(near_id, row(abs(t - u), near_id)) AS near_id FROM p JOIN v USING (user_id) GROUP BY p.event_id
""")
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join by least distance: each purchase with the closest view of its user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("near_id"), F.col("t").alias("u"))
    found = joins.nearest(e.where("event_type = 'purchase'").select("user_id", "event_id", "t"), views, ["user_id"], F.col("t"), F.col("u"), ["near_id"], ["near_id"])
    return found.select("event_id", "nearest.near_id")
