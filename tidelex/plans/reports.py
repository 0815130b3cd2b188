"""Whole reports: both levels of an axis, series with registers and control, validation, views and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.catalog import query
from tidelex.operators import rollup
from tidelex.operators.dedup import first_per
from tidelex.operators.stats import spearman
from tidelex.plans.bindings import SQL, scored, table
from tidelex.plans.page_queries import capture_rows
from tidelex.plans.series import _SERIES, _r

# Both levels. A vector whose id divides by 4 is a chunk, the others are sentences of chunks.
_LEVELS = SQL + """
    , l AS (SELECT *, CASE WHEN vec_id % 4 = 0 THEN 'chunk' ELSE 'sentence' END AS level FROM s WHERE axis IN ('altruism', 'control')),
    r AS (SELECT *, row_number() OVER (PARTITION BY axis, level, company, year ORDER BY score DESC, vec_id) AS rk FROM l),
    y AS (SELECT axis, level, company, year, avg(score) FILTER (rk <= 5) AS m, least(count(*), 5)::INT AS k_used, count(*)::INT AS n_chunks FROM r GROUP BY ALL),
    z AS (SELECT *, CASE WHEN stddev_pop(m) OVER g = 0 THEN 0 ELSE (m - avg(m) OVER g) / stddev_pop(m) OVER g END AS z FROM y WINDOW g AS (PARTITION BY axis, level, company))
"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, "altruism", "control").withColumn("level", F.when(F.col("vec_id") % 4 == 0, "chunk").otherwise("sentence"))


def _level_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.period_series(_levels(spark, sf_dir), ["axis", "level", "company"], "year", "score", "vec_id")


@query(_LEVELS + "SELECT axis, level, company, year, round(m, 6) AS raw_topk_mean, k_used, n_chunks, round(z, 6) AS zscore FROM z")
def axis_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly series of chunks and of sentences; at the sentence level n_chunks counts sentences."""
    return _level_series(spark, sf_dir).select("axis", "level", "company", "year", _r("raw_topk_mean"), "k_used", "n_chunks", _r("zscore"))


@query(_LEVELS + "SELECT axis, level, company, year, list(round(score, 4) ORDER BY rk) AS scores, list(vec_id ORDER BY rk) AS quotes FROM r WHERE rk <= 5 GROUP BY axis, level, company, year")
def nested_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of each axis, level and year, nested in the order of their ranks."""
    best = rollup.ranked(_levels(spark, sf_dir), ["axis", "level", "company", "year"], "score", "vec_id", rollup.TOP_K)
    rows = best.groupBy("axis", "level", "company", "year").agg(F.array_sort(F.collect_list(F.struct("rank", F.round("score", 4).alias("score"), "vec_id"))).alias("q"))
    return rows.select("axis", "level", "company", "year", F.transform("q", lambda x: x["score"]).alias("scores"), F.transform("q", lambda x: x["vec_id"]).alias("quotes"))


@query(_LEVELS + """
    , p AS (SELECT company, level, arg_max(year, row(z, -year)) AS peak FROM z WHERE axis = 'altruism' GROUP BY company, level)
    SELECT company, level, '- Altruism peak year: **' || peak || '** (' || CASE WHEN company % 3 = 0 THEN 'no hypothesis configured' ELSE CASE WHEN abs(peak - 2014) <= 2 THEN 'PASS' ELSE 'FAIL' END || ' vs 2014 +/- 2' END || ')' AS line FROM p
""")
def peak_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's line on the peak year of every company and level; a third of the companies expect nothing."""
    s = _level_series(spark, sf_dir).where("axis = 'altruism'")
    peak = rollup.peak_and_latest(s, ["company", "level"], "year", "zscore")
    expected = F.when(F.col("company") % 3 != 0, 2014)
    verdict = F.when(expected.isNull(), "no hypothesis configured").otherwise(F.concat(F.when(F.abs(F.col("peak_period") - expected) <= 2, "PASS").otherwise("FAIL"), F.lit(" vs "), expected.cast("string"), F.lit(" +/- 2")))
    return peak.select("company", "level", F.concat(F.lit("- Altruism peak year: **"), F.col("peak_period").cast("string"), F.lit("** ("), verdict, F.lit(")")).alias("line"))


@query(_SERIES + "SELECT company, year, string_agg('- ' || vec_id, chr(10) ORDER BY rk) AS quotes FROM r WHERE axis = 'altruism' AND rk <= 3 GROUP BY company, year")
def judge_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best quotes of a year as the lines that a judge reads."""
    best = rollup.ranked(scored(spark, sf_dir, "altruism"), ["company", "year"], "score", "vec_id", 3)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.col("vec_id").cast("string")).alias("line"))))
    return best.groupBy("company", "year").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("quotes"))


@query(_SERIES + """
    , b AS (SELECT a.company, a.year, a.m AS x, b.m AS y FROM z a JOIN z b ON a.company = b.company AND a.year = b.year AND a.axis = 'altruism' AND b.axis = 'control' WHERE a.year BETWEEN 2005 AND 2013),
    k AS (SELECT company, rank() OVER (PARTITION BY company ORDER BY x) + (count(*) OVER (PARTITION BY company, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY company ORDER BY y) + (count(*) OVER (PARTITION BY company, y) - 1) / 2.0 AS ry FROM b)
    SELECT company, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(rx, ry), 6) END AS spearman FROM k GROUP BY company
""")
def early_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of two series over 2005 to 2013, null below three years."""
    s = rollup.period_series(scored(spark, sf_dir, "altruism", "control"), ["axis", "company"], "year", "score", "vec_id").where(F.col("year").between(2005, 2013))
    one = lambda axis: s.where(F.col("axis") == axis).select("company", "year", F.col("raw_topk_mean").alias(axis))
    return spearman(one("altruism").join(one("control"), ["company", "year"]), ["company"], "altruism", "control").select("company", "n", _r("spearman"))


@query(_SERIES + "SELECT axis, company, year, round(CASE WHEN axis = 'inclusion' THEN m ELSE z END, 6) AS value FROM z WHERE axis <> 'control' AND axis IN (SELECT axis FROM z GROUP BY axis HAVING count(DISTINCT company) >= 2)")
def compared_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What companies are compared by: top-k means of inclusion, z-scores of other axes, if two companies have the axis."""
    s = rollup.period_series(scored(spark, sf_dir, "altruism", "control", "inclusion", "meritocracy"), ["axis", "company"], "year", "score", "vec_id").where("axis <> 'control'")
    shared = s.groupBy("axis").agg(F.countDistinct("company").alias("n")).where("n >= 2").select("axis")
    return s.join(shared, "axis", "left_semi").select("axis", "company", "year", F.round(F.when(F.col("axis") == "inclusion", F.col("raw_topk_mean")).otherwise(F.col("zscore")), 6).alias("value"))


@query(_SERIES + "SELECT company, year, round(max(z) FILTER (axis = 'altruism'), 6) AS value, round(max(z) FILTER (axis = 'control'), 6) AS control FROM z WHERE NOT isnan(z) GROUP BY company, year HAVING max(z) FILTER (axis = 'altruism') IS NOT NULL")
def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart's rows: the axis beside its control, rows without a number left out."""
    s = rollup.period_series(scored(spark, sf_dir, "altruism", "control"), ["axis", "company"], "year", "score", "vec_id").where(~F.isnan("zscore"))
    value = lambda axis: F.round(F.max(F.when(F.col("axis") == axis, F.col("zscore"))), 6).alias(axis)
    return s.groupBy("company", "year").agg(value("altruism"), value("control")).where("altruism is not null").select("company", "year", F.col("altruism").alias("value"), "control")


@query(_SERIES + "SELECT company, list_extract(ys, len(ys) // 2 + 1) AS default_year, len(ys) AS n_years FROM (SELECT company, list(DISTINCT year ORDER BY year) AS ys FROM z GROUP BY company)")
def default_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year that a view of a company opens with: the middle one of its years."""
    years = scored(spark, sf_dir, "altruism").groupBy("company").agg(F.array_sort(F.collect_set("year")).alias("years"))
    return years.select("company", F.element_at("years", (F.floor(F.size("years") / 2) + 1).cast("int")).alias("default_year"), F.size("years").cast("long").alias("n_years"))


# Documents and vectors of one id make one scored chunk.
_CHUNKS = SQL + r"""
    , w AS (SELECT vec_id, max(score) FILTER (axis = 'inclusion') AS inc, max(score) FILTER (axis = 'meritocracy') AS mer FROM s GROUP BY vec_id),
    c AS (
        SELECT doc_id, source AS company, (2005 + doc_id // 20 % 10)::INT AS year, text, inc, mer,
               CASE WHEN doc_id % 7 = 0 THEN NULL WHEN contains(lower(text), 'the') THEN 'aspirational_vague' WHEN contains(lower(text), 'der') THEN 'meritocracy' WHEN contains(lower(text), 'les') THEN 'civilizational_mission' ELSE 'absent' END AS register
        FROM documents JOIN w ON doc_id = vec_id
    ),
    o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY company, year, text ORDER BY doc_id) = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY inc DESC, doc_id) AS ri, row_number() OVER (PARTITION BY company, year ORDER BY mer DESC, doc_id) AS rm FROM o),
    b AS (
        SELECT company, year, count(*) AS n_chunks, avg(inc) FILTER (ri <= 5) AS inc_topk, avg(mer) FILTER (rm <= 5) AS mer_topk, avg(inc - mer) AS stance, count(*) FILTER (register = 'aspirational_vague') AS active,
               count(*) FILTER (register = 'meritocracy') AS merit, count(*) FILTER (register = 'civilizational_mission') AS civil FROM k GROUP BY company, year
    )
"""


def _scored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir, "inclusion", "meritocracy").groupBy("vec_id").agg(*[F.max(F.when(F.col("axis") == a, F.col("score"))).alias(n) for a, n in (("inclusion", "inc"), ("meritocracy", "mer"))])
    low = F.lower("text")
    register = F.when(F.col("doc_id") % 7 == 0, None).when(low.contains("the"), "aspirational_vague").when(low.contains("der"), "meritocracy").when(low.contains("les"), "civilizational_mission").otherwise("absent")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("company"), (2005 + F.floor(F.col("doc_id") / 20) % 10).cast("int").alias("year"), "text", register.alias("register"))
    return first_per(docs.join(s, docs["doc_id"] == s["vec_id"]).drop("vec_id"), ["company", "year", F.xxhash64("text"), "text"], ["doc_id"])


def _register_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by = _scored_chunks(spark, sf_dir), ["company", "year"]
    top = lambda c, name: rollup.topk_mean(rows, by, c, "doc_id").select(*by, F.col("raw_topk_mean").alias(name))
    n = lambda r, name: F.count_if(F.col("register") == r).alias(name)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.col("inc") - F.col("mer")).alias("stance"), n("aspirational_vague", "active"), n("meritocracy", "merit"), n("civilizational_mission", "civil"))
    return counts.join(top("inc", "inc_topk"), by).join(top("mer", "mer_topk"), by)


@query(_CHUNKS + """
    , t AS (SELECT DISTINCT company, year, text FROM k), y AS (SELECT DISTINCT company, year FROM t), p AS (SELECT *, lag(year) OVER (PARTITION BY company ORDER BY year) AS before FROM y),
    churn AS (SELECT t.company, t.year, avg((u.text IS NULL)::INT) AS churn, count(*) AS n_texts FROM t JOIN p USING (company, year) LEFT JOIN t u ON u.company = t.company AND u.year = p.before AND u.text = t.text GROUP BY t.company, t.year),
    ctl AS (SELECT year, avg(score) AS control FROM s WHERE axis = 'control' GROUP BY year)
    SELECT company, year, n_chunks, n_texts AS n_unique_texts, round(churn, 6) AS text_churn, round(inc_topk, 6) AS inclusion_topk_mean, round(mer_topk, 6) AS meritocracy_topk_mean, round(inc_topk - mer_topk, 6) AS net_score,
           round(active / n_chunks, 6) AS active_share, round(merit / n_chunks, 6) AS meritocracy_share, round((merit + civil) / n_chunks, 6) AS counter_share, round(control, 6) AS control_mean
    FROM b JOIN churn USING (company, year) LEFT JOIN ctl USING (year)
""")  # fmt: skip
def register_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, registers, churn and the control's overlay of a company's years in one table, over texts that are unique in their year."""
    by = ["company", "year"]
    base, churn = _register_series(spark, sf_dir), rollup.text_churn(_scored_chunks(spark, sf_dir), ["company"], "year", "text")
    control = scored(spark, sf_dir, "control").groupBy("year").agg(F.avg("score").alias("control"))
    share = lambda c: F.round(c / F.col("n_chunks"), 6)
    return base.join(churn, by).join(control, "year", "left").select(
        *by, "n_chunks", "n_unique_texts", _r("text_churn"), F.round("inc_topk", 6).alias("inclusion_topk_mean"), F.round("mer_topk", 6).alias("meritocracy_topk_mean"), F.round(F.col("inc_topk") - F.col("mer_topk"), 6).alias("net_score"),
        share(F.col("active")).alias("active_share"), share(F.col("merit")).alias("meritocracy_share"), share(F.col("merit") + F.col("civil")).alias("counter_share"), F.round("control", 6).alias("control_mean"),
    )


@query(_CHUNKS + """
    , e AS (SELECT company, year, arg_max(doc_id, row(inc - mer, -doc_id)) AS hi, arg_min(doc_id, row(inc - mer, doc_id)) AS lo FROM k WHERE company <> 'src2' GROUP BY company, year)
    SELECT b.company, b.year, round(b.stance, 6) AS stance, e.hi AS upper_quote, e.lo AS lower_quote, e.hi IS NOT NULL AND e.lo IS NOT NULL AND n_chunks > 1 AS band FROM b LEFT JOIN e ON b.company = e.company AND b.year = e.year
""")
def stance_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean stance with the quotes at its ends; excluded companies keep their line and have no band."""
    rows, by = _scored_chunks(spark, sf_dir), ["company", "year"]
    diff = F.col("inc") - F.col("mer")
    ends = rows.where("company <> 'src2'").groupBy(*by).agg(F.min_by("doc_id", F.struct(-diff, F.col("doc_id"))).alias("upper_quote"), F.min_by("doc_id", F.struct(diff, F.col("doc_id"))).alias("lower_quote"))
    out = rows.groupBy(*by).agg(F.avg(diff).alias("stance"), F.count(F.lit(1)).alias("n")).join(ends, by, "left")
    return out.select(*by, _r("stance"), "upper_quote", "lower_quote", (F.col("upper_quote").isNotNull() & F.col("lower_quote").isNotNull() & (F.col("n") > 1)).alias("band"))


@query(_CHUNKS + """
    , h AS (SELECT *, CASE register WHEN 'aspirational_vague' THEN 'affirming_dei' WHEN 'meritocracy' THEN 'performance_elite' WHEN 'civilizational_mission' THEN 'civilizational_mission' ELSE 'neutral' END AS hint,
                      CASE WHEN inc > mer THEN 'affirming_dei' ELSE 'performance_elite' END AS stance FROM c)
    SELECT company, count(*) AS n, round(avg((hint = stance)::INT), 6) AS agreement, count(*) FILTER (hint = 'neutral') AS n_neutral FROM h GROUP BY company
""")
def stance_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the stance that a register hints at is the one that the scores give; no register hints at neutral."""
    hints = spark.createDataFrame([("aspirational_vague", "affirming_dei"), ("meritocracy", "performance_elite"), ("civilizational_mission", "civilizational_mission")], "register string, hint string")
    s = scored(spark, sf_dir, "inclusion", "meritocracy").groupBy("vec_id").agg(*[F.max(F.when(F.col("axis") == a, F.col("score"))).alias(n) for a, n in (("inclusion", "inc"), ("meritocracy", "mer"))])
    low = F.lower("text")
    register = F.when(F.col("doc_id") % 7 == 0, None).when(low.contains("the"), "aspirational_vague").when(low.contains("der"), "meritocracy").when(low.contains("les"), "civilizational_mission").otherwise("absent")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("company"), register.alias("register"))
    rows = docs.join(s, docs["doc_id"] == s["vec_id"]).join(F.broadcast(hints), "register", "left").withColumn("hint", F.coalesce("hint", F.lit("neutral")))
    stance = F.when(F.col("inc") > F.col("mer"), "affirming_dei").otherwise("performance_elite")
    return rows.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("hint") == stance).cast("double")), 6).alias("agreement"), F.count_if(F.col("hint") == "neutral").alias("n_neutral"))


# Captures: events of users as captures of their pages.
_CAPTURES = "WITH c AS (SELECT user_id, event_id, event_type, strftime(ts, '%Y%m%d%H%M%S') AS ts, ts::DATE AS d FROM events)"


@query(_CAPTURES + "SELECT substr(ts, 1, 4)::INT AS year, substr(ts, 5, 2)::INT AS month, count(*) AS n_captures, count(DISTINCT user_id) AS n_urls FROM c GROUP BY ALL")
def candidates_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many captures and distinct pages each month offers."""
    c = capture_rows(spark, sf_dir)
    return c.groupBy(F.substring("timestamp", 1, 4).cast("int").alias("year"), F.substring("timestamp", 5, 2).cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n_captures"), F.countDistinct("urlkey").alias("n_urls"))


@query("""
    WITH e AS (SELECT event_id, '/api/' || event_type || '/' || (user_id % 5) AS url, props FROM events),
    t AS (SELECT *, split_part(split_part(url, '/api/', 2), '/', 1) AS endpoint, contains(lower(props), 'k') AS has_keywords FROM e),
    n AS (SELECT greatest(1, 40 // count(DISTINCT endpoint)) AS per FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY sha256('42|' || event_id), event_id) AS rk FROM t)
    SELECT event_id, endpoint, has_keywords FROM r, n WHERE rk <= per
""")
def endpoint_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 40 payloads spread over the types of their endpoints, with a probe for keywords."""
    url = F.concat(F.lit("/api/"), "event_type", F.lit("/"), (F.col("user_id") % 5).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", F.split_part(F.split_part(url, F.lit("/api/"), F.lit(2)), F.lit("/"), F.lit(1)).alias("endpoint"), F.lower("props").contains("k").alias("has_keywords"))
    per = rows.agg(F.greatest(F.lit(1), F.floor(F.lit(40) / F.countDistinct("endpoint"))).alias("per"))
    h = F.sha2(F.concat_ws("|", F.lit("42"), F.col("event_id").cast("string")), 256)
    ranked = rows.withColumn("rk", F.row_number().over(Window.partitionBy("endpoint").orderBy(h, "event_id")))
    return ranked.join(F.broadcast(per), F.col("rk") <= F.col("per")).select("event_id", "endpoint", "has_keywords")


@query("""
    WITH old AS (SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0), fresh AS (SELECT doc_id, source FROM documents WHERE source = 'src1'),
    keep AS (SELECT o.doc_id, d.source, quality FROM old o JOIN documents d USING (doc_id) WHERE d.source <> 'src1'),
    pick AS (SELECT doc_id, source, NULL::INT AS quality FROM fresh ORDER BY sha256('42|' || doc_id), doc_id LIMIT 20)
    SELECT doc_id, source, quality::INT AS quality FROM keep UNION ALL FROM pick
""")
def refreshed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled sample in which one company's rows are drawn anew and the other companies' rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    keep = table(spark, sf_dir, "labels").where("doc_id % 2 = 0").select("doc_id", F.col("quality").cast("int").alias("quality")).join(docs.where("source <> 'src1'"), "doc_id").select("doc_id", "source", "quality")
    pick = docs.where("source = 'src1'").orderBy(F.sha2(F.concat_ws("|", F.lit("42"), F.col("doc_id").cast("string")), 256), "doc_id").limit(20)
    return keep.unionByName(pick.withColumn("quality", F.lit(None).cast("int")))


@query(_SERIES + """
    , yrs AS (SELECT DISTINCT year FROM z), p AS (SELECT a.year AS a, b.year AS b FROM yrs a JOIN yrs b ON a.year < b.year)
    SELECT CASE WHEN flip THEN b ELSE a END AS first, CASE WHEN flip THEN a ELSE b END AS second FROM (SELECT *, substr(h, 1, 1) < '8' AS flip FROM (SELECT *, sha256('42|' || a || '|' || b) AS h FROM p) ORDER BY h LIMIT 40)
""")
def tournament_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty pairs of years for a judge, drawn and turned round by a seeded hash."""
    years = scored(spark, sf_dir, "altruism").select("year").distinct()
    a, b = years.select(F.col("year").alias("a")), years.select(F.col("year").alias("b"))
    h = F.sha2(F.concat_ws("|", F.lit("42"), F.col("a").cast("string"), F.col("b").cast("string")), 256)
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("h", h).orderBy("h").limit(40)
    flip = F.substring("h", 1, 1) < "8"
    return pairs.select(F.when(flip, F.col("b")).otherwise(F.col("a")).alias("first"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("second"))


@query(_SERIES + "SELECT min(year) AS coverage_start, max(year) AS coverage_end, count(DISTINCT year) AS n_years, count(DISTINCT company) AS n_companies FROM z")
def coverage_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last year of any company."""
    return scored(spark, sf_dir, "altruism").agg(F.min("year").alias("coverage_start"), F.max("year").alias("coverage_end"), F.countDistinct("year").alias("n_years"), F.countDistinct("company").alias("n_companies"))



@query(_CHUNKS + """
    , a AS (SELECT company, count(*) FILTER (register = 'absent' AND inc > 0.1) AS n_absent_but_high, count(*) AS n, corr(inc, mer) AS r FROM c GROUP BY company)
    SELECT company, n, n_absent_but_high, CASE WHEN n >= 3 THEN round(r, 3) END AS pearson, CASE WHEN n >= 3 THEN abs(round(r, 3)) < 0.5 END AS decoupled FROM a
""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per company how the two scores go together, and how many texts score high though their register is absent."""
    s = scored(spark, sf_dir, "inclusion", "meritocracy").groupBy("vec_id").agg(*[F.max(F.when(F.col("axis") == a, F.col("score"))).alias(n) for a, n in (("inclusion", "inc"), ("meritocracy", "mer"))])
    low = F.lower("text")
    absent = (F.col("doc_id") % 7 != 0) & ~low.contains("the") & ~low.contains("der") & ~low.contains("les")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("company"), absent.alias("absent"))
    out = docs.join(s, docs["doc_id"] == s["vec_id"]).groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("absent") & (F.col("inc") > 0.1)).alias("n_absent_but_high"), F.round(F.corr("inc", "mer"), 3).alias("r"))
    enough = F.col("n") >= 3
    return out.select("company", "n", "n_absent_but_high", F.when(enough, F.col("r")).alias("pearson"), F.when(enough, F.abs("r") < 0.5).alias("decoupled"))
