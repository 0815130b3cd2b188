"""Axis and stance series over scored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.catalog import query
from tidelex.functions.vectors import build_axes, cosine, project
from tidelex.operators import rollup
from tidelex.operators.cosine import close_pairs
from tidelex.plans.bindings import SQL, axes, scored, table, vectors


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


_SERIES = SQL + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY axis, company, year ORDER BY score DESC, vec_id) AS rk FROM s),
    y AS (SELECT axis, company, year, avg(score) FILTER (rk <= 5) AS m, least(count(*), 5)::INT AS k_used, count(*)::INT AS n_chunks FROM r GROUP BY ALL),
    z AS (SELECT *, CASE WHEN stddev_pop(m) OVER g = 0 THEN 0 ELSE (m - avg(m) OVER g) / stddev_pop(m) OVER g END AS z FROM y WINDOW g AS (PARTITION BY axis, company))
"""


@query(_SERIES + "SELECT axis, company, year, round(m, 6) AS raw_topk_mean, k_used, n_chunks, round(z, 6) AS zscore FROM z WHERE axis IN ('altruism', 'control')")
def axis_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive top-k mean and z-score per axis, company and year."""
    out = rollup.period_series(scored(spark, sf_dir, "altruism", "control"), ["axis", "company"], "year", "score", "vec_id")
    return out.select("axis", "company", "year", _r("raw_topk_mean"), "k_used", "n_chunks", _r("zscore"))


@query(SQL + "SELECT axis, single, (unnest(generate_series(1, len(vector))) - 1)::INT AS i, round(unnest(vector), 9) AS value FROM (SELECT axis, axis <> 'altruism' AS single, vector FROM ax)")
def axis_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes(spark, sf_dir).select("axis", F.col("single_pole").alias("single"), F.posexplode("vector").alias("i", "value")).withColumn("value", F.round("value", 9))


@query(SQL + "SELECT vec_id, axis, round(score, 6) AS score FROM s")
def axis_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, "altruism", "control", "inclusion", "meritocracy").select("vec_id", "axis", _r("score"))


@query(_SERIES + "SELECT axis, company, year, rk::INT AS rank, vec_id, round(score, 4) AS score FROM r WHERE rk <= 5 AND axis = 'inclusion'")
def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of each year in order."""
    out = rollup.ranked(scored(spark, sf_dir, "inclusion"), ["axis", "company", "year"], "score", "vec_id", rollup.TOP_K)
    return out.select("axis", "company", "year", "rank", "vec_id", _r("score", 4))


_WIDE = SQL + """
    , w AS (SELECT vec_id, company, year, max(score) FILTER (axis = 'inclusion') AS inclusion, max(score) FILTER (axis = 'meritocracy') AS meritocracy FROM s GROUP BY ALL),
    d AS (SELECT *, inclusion - meritocracy AS stance, greatest(inclusion, meritocracy) AS salience FROM w)
"""


def _two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir, "inclusion", "meritocracy")
    return s.groupBy("vec_id", "company", "year").agg(*[F.max(F.when(F.col("axis") == a, F.col("score"))).alias(a) for a in ("inclusion", "meritocracy")])


@query(_WIDE + """
    , q AS (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY inclusion DESC, vec_id) AS ri, row_number() OVER (PARTITION BY company, year ORDER BY meritocracy DESC, vec_id) AS rm,
                   row_number() OVER (PARTITION BY company, year ORDER BY salience DESC, vec_id) AS rs FROM d)
    SELECT company, year, count(*)::INT AS n_chunks, round(avg(inclusion), 6) AS inclusion_mean, round(avg(inclusion) FILTER (ri <= 5), 6) AS inclusion_topk_mean, round(max(inclusion), 6) AS inclusion_max,
           round(avg((inclusion >= 0.25)::INT), 6) AS inclusion_present, round(avg(meritocracy), 6) AS meritocracy_mean, round(avg(meritocracy) FILTER (rm <= 5), 6) AS meritocracy_topk_mean,
           round(max(meritocracy), 6) AS meritocracy_max, round(avg((meritocracy >= 0.25)::INT), 6) AS meritocracy_present, round(max(stance), 6) AS stance_max, round(min(stance), 6) AS stance_min,
           round(avg(stance), 6) AS stance_mean, round(avg(salience) FILTER (rs <= 5), 6) AS salience_topk_mean, arg_max(vec_id, stance) AS stance_max_id, arg_min(vec_id, stance) AS stance_min_id
    FROM q GROUP BY company, year
""")  # fmt: skip
def stance_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores per group with the extremes of their difference."""
    out = rollup.stance_series(_two_scores(spark, sf_dir), ["company", "year"], "inclusion", "meritocracy", "vec_id")
    return out.select(*[_r(c) if t == "double" else c for c, t in out.dtypes])


@query(SQL + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY score DESC, vec_id) AS rk FROM s WHERE axis = 'altruism')
    SELECT company, year, count(*)::INT AS n_chunks, round(avg(score) FILTER (rk <= 5), 6) AS topk_mean, round(avg(score), 6) AS mean, round(max(score), 6) AS max, round(min(score), 6) AS min,
           least(count(*), 5)::INT AS k_used, round(avg(abs(score)) FILTER (rk <= 5), 6) AS salience FROM r GROUP BY company, year
""")  # fmt: skip
def bipolar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.bipolar_series(scored(spark, sf_dir, "altruism"), ["company", "year"], "score", "vec_id")
    return out.select(*[_r(c) if t == "double" else c for c, t in out.dtypes])


@query(SQL + """
    , p AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 'investor' ELSE 'careers' END AS source, row_number() OVER (PARTITION BY vec_id % 3 = 0, company, year ORDER BY score DESC, vec_id) AS rk FROM s WHERE axis = 'inclusion')
    SELECT company, source, year, count(*)::INT AS n_chunks, round(avg(score), 6) AS mean, round(avg(score) FILTER (rk <= 5), 6) AS topk_mean, round(max(score), 6) AS max,
           round(avg((score >= 0.25)::INT), 6) AS fraction_present, count(*) < 5 AS thin FROM p GROUP BY company, source, year
""")  # fmt: skip
def performance_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and year, careers and investor rows apart, thin years marked."""
    s = scored(spark, sf_dir, "inclusion").withColumn("source", F.when(F.col("vec_id") % 3 == 0, "investor").otherwise("careers"))
    by = ["company", "source", "year"]
    whole = s.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n_chunks"), F.avg("score").alias("mean"), F.max("score").alias("max"), rollup.presence("score").alias("fraction_present"))
    out = rollup.same_keys(whole, rollup.topk_mean(s, by, "score", "vec_id").withColumnRenamed("raw_topk_mean", "topk_mean"), by)
    return out.select(*by, "n_chunks", _r("mean"), _r("topk_mean"), _r("max"), _r("fraction_present"), (F.col("n_chunks") < rollup.TOP_K).alias("thin"))


@query(SQL + """
    , yrs AS (SELECT DISTINCT company, year FROM v), prev AS (SELECT *, lag(year) OVER (PARTITION BY company ORDER BY year) AS before FROM yrs),
    hit AS (SELECT DISTINCT a.vec_id FROM v a JOIN prev p ON a.company = p.company AND a.year = p.year JOIN v b ON b.company = p.company AND b.year = p.before WHERE list_inner_product(a.u, b.u) >= 0.25)
    SELECT v.company, v.year, CASE WHEN any_value(p.before) IS NOT NULL THEN round(avg((h.vec_id IS NOT NULL)::INT), 6) END AS carried_forward_frac
    FROM v JOIN prev p USING (company, year) LEFT JOIN hit h ON v.vec_id = h.vec_id GROUP BY v.company, v.year
""")  # fmt: skip
def carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a year's vectors that are close to one of the year before that has any."""
    return rollup.carried_forward(vectors(spark, sf_dir), ["company"], "year", "vec_id", "embedding", threshold=0.25).select("company", "year", _r("carried_forward_frac"))


@query(SQL + "SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.u, b.u), 6) AS cosine FROM v a JOIN v b ON a.company = b.company AND a.vec_id < b.vec_id WHERE list_inner_product(a.u, b.u) >= 0.3")
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one company at a cosine of 0.3 or more."""
    v = vectors(spark, sf_dir).select("company", "vec_id", "embedding")
    return close_pairs(v, v, ["company"], "vec_id", "embedding", 0.3, ordered=True).select("a", "b", _r("cosine"))


@query(_SERIES + "SELECT coalesce(a.company, b.company) AS company, coalesce(a.year, b.year) AS year, round(a.z, 6) AS altruism, round(b.z, 6) AS control FROM (FROM z WHERE axis = 'altruism') a FULL JOIN (FROM z WHERE axis = 'control') b ON a.company = b.company AND a.year = b.year")
def axis_overlay_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series of every company side by side, on the union of their years."""
    s = rollup.period_series(scored(spark, sf_dir, "altruism", "control"), ["axis", "company"], "year", "score", "vec_id")
    one = lambda axis: s.where(F.col("axis") == axis).select("company", "year", F.col("zscore").alias(axis))
    return one("altruism").join(one("control"), ["company", "year"], "full").select("company", "year", _r("altruism"), _r("control"))


@query(_SERIES + """
    SELECT company, arg_max(year, m) AS peak_period, round(max(m), 6) AS peak_value, max(year) AS latest_period, round(arg_max(m, year), 6) AS latest_value FROM z WHERE axis = 'altruism' GROUP BY company
""")
def peak_and_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rollup.period_series(scored(spark, sf_dir, "altruism"), ["company"], "year", "score", "vec_id")
    return rollup.peak_and_latest(s, ["company"], "year", "raw_topk_mean").select("company", "peak_period", _r("peak_value"), "latest_period", _r("latest_value"))


@query(_SERIES + """
    , f AS (SELECT company, year, lag(z) OVER w - z AS fall, first_value(year) OVER (PARTITION BY company ORDER BY z DESC, year) AS peak FROM z WHERE axis = 'altruism' WINDOW w AS (PARTITION BY company ORDER BY year))
    SELECT company, arg_min(year, row(-fall, year)) FILTER (year >= peak AND fall > 0) AS retraction_period, round(max(fall) FILTER (year >= peak AND fall > 0), 6) AS drop FROM f GROUP BY company
""")
def retraction_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rollup.period_series(scored(spark, sf_dir, "altruism"), ["company"], "year", "score", "vec_id")
    return rollup.largest_drop(s, ["company"], "year", "zscore").select("company", "retraction_period", _r("drop"))


@query(_SERIES + """
    , p AS (SELECT company, arg_max(year, z) AS py, max(z) AS pz, max(year) AS ly, arg_max(z, year) AS lz FROM z WHERE axis = 'altruism' GROUP BY company)
    SELECT company, CASE WHEN py = ly THEN 'at_high' WHEN lz - pz > -0.25 THEN 'steady' WHEN lz - pz > -1 THEN 'declined' ELSE 'declined_sharply' END AS trend FROM p
""")
def trend_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rollup.period_series(scored(spark, sf_dir, "altruism"), ["company"], "year", "score", "vec_id")
    return rollup.trend(s, ["company"], "year", "zscore").select("company", "trend")


@query(_SERIES + "SELECT axis, year, round(avg(z), 6) AS industry_mean, count(z) AS n_groups FROM z WHERE axis IN ('altruism', 'control') GROUP BY axis, year")
def industry_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rollup.period_series(scored(spark, sf_dir, "altruism", "control"), ["axis", "company"], "year", "score", "vec_id")
    return s.groupBy("axis", "year").agg(F.round(F.avg("zscore"), 6).alias("industry_mean"), F.count("zscore").alias("n_groups"))


@query(_SERIES + """
    , u AS (SELECT DISTINCT company FROM z), t AS (SELECT DISTINCT year FROM z)
    SELECT u.company, t.year, CASE WHEN m IS NULL THEN NULL WHEN m <= 0.01 THEN 0 WHEN m < 0.15 THEN 1 WHEN m < 0.3 THEN 2 WHEN m < 0.5 THEN 3 ELSE 4 END::INT AS band
    FROM u CROSS JOIN t LEFT JOIN (FROM z WHERE axis = 'inclusion') y ON y.company = u.company AND y.year = t.year
""")
def heatmap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company and year, with the band of its value or null."""
    s = rollup.period_series(scored(spark, sf_dir, "inclusion"), ["company"], "year", "score", "vec_id")
    years = s.agg(F.array_sort(F.collect_set("year")).alias("years"))
    grid = s.select("company").distinct().join(F.broadcast(years), F.lit(True)).select("company", F.explode("years").alias("year"))
    return grid.join(s, ["company", "year"], "left").select("company", "year", rollup.bands(F.col("raw_topk_mean")).cast("int").alias("band"))


@query(_SERIES + "SELECT axis, count(DISTINCT company) AS n_companies FROM z WHERE axis <> 'control' GROUP BY axis HAVING count(DISTINCT company) >= 2")
def comparable_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir, "altruism", "control", "inclusion", "meritocracy").where("axis <> 'control'")
    return s.groupBy("axis").agg(F.countDistinct("company").alias("n_companies")).where("n_companies >= 2")


@query(SQL + """
    , b AS (SELECT vec_id, u FROM v WHERE vec_id < 16), o AS (SELECT vec_id, u FROM v WHERE vec_id >= 16)
    SELECT b.vec_id AS sentence, arg_max(o.vec_id, list_inner_product(b.u, o.u)) AS closest, round(max(list_inner_product(b.u, o.u)), 3) AS cosine, max(list_inner_product(b.u, o.u)) >= 0.3 AS flagged FROM b, o GROUP BY b.vec_id
""")
def circularity_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pole sentences against the corpus: the closest vector, flagged at 0.3 or more."""
    v = table(spark, sf_dir, "embeddings")
    poles = v.where("vec_id < 16").select(F.col("vec_id").alias("sentence"), F.col("embedding").alias("p"))
    pairs = v.where("vec_id >= 16").join(F.broadcast(poles), F.lit(True)).select("sentence", "vec_id", cosine(F.col("p"), F.col("embedding")).alias("c"))
    out = pairs.groupBy("sentence").agg(F.min_by("vec_id", F.struct(-F.col("c"), F.col("vec_id"))).alias("closest"), F.max("c").alias("c"))
    return out.select("sentence", "closest", F.round("c", 3).alias("cosine"), (F.col("c") >= 0.3).alias("flagged"))


_LOO = """
    WITH raw AS (SELECT vec_id, label AS company, (2005 + vec_id % 20)::INT AS year, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    v AS (SELECT vec_id, company, year, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM raw),
    variant AS (SELECT unnest(generate_series(-1, 15)) AS variant),
    comp AS (
        SELECT variant, i, avg(x) FILTER (vec_id < 8) - avg(x) FILTER (vec_id >= 8) AS x
        FROM (SELECT vec_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM v WHERE vec_id < 16) p JOIN variant ON variant.variant <> p.vec_id GROUP BY variant, i
    ),
    ax AS (SELECT variant, list(x ORDER BY i) AS a FROM comp GROUP BY variant),
    y AS (
        SELECT variant, year, avg(score) AS m FROM (
            SELECT variant, year, score, row_number() OVER (PARTITION BY variant, year ORDER BY score DESC, vec_id) AS rk
            FROM (SELECT variant, vec_id, year, list_inner_product(u, a) / sqrt(list_inner_product(a, a)) AS score FROM v, ax)
        ) WHERE rk <= 5 GROUP BY variant, year
    ),
    r AS (SELECT variant, year, rank() OVER (PARTITION BY variant ORDER BY m) + (count(*) OVER (PARTITION BY variant, m) - 1) / 2.0 AS k FROM y)
    SELECT a.variant AS dropped, round(corr(a.k, b.k), 6) AS spearman, corr(a.k, b.k) >= 0.8 AS robust FROM r a JOIN r b ON b.variant = -1 AND a.year = b.year WHERE a.variant >= 0 GROUP BY a.variant
"""


@query(_LOO)
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly series with each pole sentence left out in turn, against the whole axis: all variants in one pass."""
    from tidelex.operators.stats import spearman

    v = vectors(spark, sf_dir)
    variants = spark.range(-1, 16).select(F.col("id").alias("variant"))
    poles = v.where("vec_id < 16").join(F.broadcast(variants), F.col("variant") != F.col("vec_id"))
    built = build_axes(poles.select(F.col("variant").cast("string").alias("axis"), F.when(F.col("vec_id") < 8, "a").otherwise("b").alias("pole"), "embedding"))
    yearly = rollup.topk_mean(project(v, built), ["axis", "year"], "score", "vec_id")
    base = yearly.where("axis = '-1'").select("year", F.col("raw_topk_mean").alias("base"))
    both = yearly.where("axis <> '-1'").join(base, "year")
    out = spearman(both, ["axis"], "raw_topk_mean", "base")
    return out.select(F.col("axis").cast("long").alias("dropped"), F.round("spearman", 6).alias("spearman"), (F.col("spearman") >= 0.8).alias("robust"))
