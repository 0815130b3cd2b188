"""Stories over labelled and embedded texts: phrases, highlights by stance, investor series, validation, view filters.

Texts are documents behind a phrase that the shipped patterns find; a third of them stand for investor filings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.catalog import query
from tidelex.functions import classify
from tidelex.functions.vectors import along
from tidelex.operators import curate, rollup
from tidelex.operators.dedup import first_per
from tidelex.operators.models import embedded
from tidelex.operators.scoring import sentence_rows
from tidelex.operators.stats import p_value, spearman
from tidelex.plans.bindings import EMBEDDER, MODEL_SQL, VECTOR, chunks, sentence_axes
from tidelex.storage import kept, scratch

PHRASES = [
    "Work hard, play hard.", "We raise the bar.", "No set hours here.", "Move fast.", "Optimize for impact.", "The hardest problems need the smartest people.", "We are not a family.", "A championship team.",
    "We are mission-focused.", "Competition for qualified personnel is strong.", "Diversity and Accessibility for all women.", "Top talent wins.", "Nothing to see.", "Judged by outcomes.",
]
AXES = ["inclusion", "meritocracy", "control"]


def _register(text):
    return F.when(F.length(text) % 3 == 0, "absent").when(F.length(text) % 3 == 1, "aspirational_vague").otherwise("meritocracy")


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TEXTS = MODEL_SQL + f"""
    , sx AS (
        SELECT doc_id, source AS company, (2005 + doc_id // 20 % 10)::INT AS year, CASE WHEN doc_id // 7 % 3 = 0 THEN 'investor' ELSE 'careers' END AS source, chunk_id,
               CASE doc_id % {len(PHRASES)} {' '.join(f"WHEN {k} THEN {_sql(p)}" for k, p in enumerate(PHRASES))} END || ' ' || text AS text
        FROM (SELECT *, company AS source FROM mc)
    ),
    sv AS (SELECT *, CASE length(text) % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'aspirational_vague' ELSE 'meritocracy' END AS register, {VECTOR.format('text')} AS e FROM sx),
    su AS (SELECT * EXCLUDE e, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM sv),
    sy AS (SELECT su.* EXCLUDE u, {', '.join(f"list_inner_product(u, (SELECT vector FROM bx WHERE axis = '{a}')) AS {a}" for a in AXES)} FROM su)
"""


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """Texts, axes and the cache of vectors."""
    cache = scratch(spark, "vectors")
    axes = kept(sentence_axes(spark, sf_dir, cache).where(F.col("axis").isin(AXES)), "axes")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    rows = chunks(spark, sf_dir).where("text is not null").select(
        "doc_id", "chunk_id", "company", F.col("company").alias("heading"), (2005 + F.floor(F.col("doc_id") / 20) % 10).cast("int").alias("year"),
        F.when(F.floor(F.col("doc_id") / 7) % 3 == 0, "investor").otherwise("careers").alias("source"), F.concat(phrase, F.lit(" "), "text").alias("text"),
    )
    return rows.withColumn("register", _register(F.col("text"))), axes, cache


def _scored(rows: DataFrame, axes: DataFrame, cache: str) -> DataFrame:
    """The rows with a column for each axis, null for one that there is not; no rows without any axis."""
    wide = axes.agg(*[F.max(F.when(F.col("axis") == a, F.col("vector"))).alias(f"__{a}") for a in AXES]).where(F.coalesce(*[F.col(f"__{a}") for a in AXES]).isNotNull())
    vectors = embedded(rows, EMBEDDER, cache).join(F.broadcast(wide))
    return vectors.select(*rows.columns, *[F.when(F.col(f"__{a}").isNotNull(), along(F.col("embedding"), F.col(f"__{a}"))).alias(a) for a in AXES])


def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, axes, cache = _texts(spark, sf_dir)
    return _scored(rows, axes, cache)


def _said(spark: SparkSession, sf_dir: str, wanted: Column | None = None) -> DataFrame:
    """Scored sentences; with ``wanted``, a condition on text, those alone are embedded."""
    rows, axes, cache = _texts(spark, sf_dir)
    said = sentence_rows(rows)
    return _scored(kept(said if wanted is None else said.where(wanted), "sentences"), axes, cache)


_SAID = _TEXTS + rf"""
    , cl AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM sx),
    pa AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?…])\s+([A-Z"''(])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda s: trim(s)), lambda s: len(string_split(s, ' ')) >= 6) AS many FROM cl),
    pb AS (SELECT *, CASE WHEN len(many) > 0 THEN many WHEN len(string_split(t, ' ')) >= 6 THEN [t] ELSE [] END AS ss FROM pa),
    se AS (SELECT company, year, chunk_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS position FROM pb),
    s1 AS (SELECT * FROM se QUALIFY row_number() OVER (PARTITION BY company, year, text ORDER BY chunk_id, position) = 1),
    s2 AS (SELECT *, substr(sha256(concat_ws('|', chunk_id, position::VARCHAR, text)), 1, 16) AS sentence_id, {VECTOR.format('text')} AS e FROM s1),
    sc AS (SELECT *, list_inner_product(e, (SELECT vector FROM bx WHERE axis = 'inclusion')) / sqrt(list_inner_product(e, e)) AS score FROM s2)
"""


@query(_SAID + f"""
    , hit AS (SELECT *, lower(unnest(regexp_extract_all(text, '{classify.INCLUSION_TERMS}'))) AS term FROM sc)
    SELECT company, term, min(year) AS first_year, max(year) AS last_year, round(max(score), 4) AS max_score, count(*) AS n_hits, substr(arg_min(text, row(-score, sentence_id)), 1, 200) AS example FROM hit GROUP BY company, term
""")
def inclusion_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's inclusion terms over the years, with the sentence that scores best along the axis."""
    found = curate.found_terms(_said(spark, sf_dir, F.rlike("text", F.lit(classify.INCLUSION_TERMS))), "text", classify.INCLUSION_TERMS)
    return curate.term_tracking(found, "term", "year", "inclusion", "text", "sentence_id", by=["company"]).withColumn("max_score", F.round("max_score", 4))


@query(_SAID + "SELECT substr(sha256(text), 1, 12) AS sentence_id, company, year, text, round(max(score), 4) AS score FROM sc WHERE score >= 0.3 GROUP BY company, year, text")
def inclusion_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences at 0.30 or more along the inclusion axis, each once a year of its company."""
    best = curate.high_scoring(_said(spark, sf_dir), ["company", "year"], "text", "inclusion", 0.3)
    return best.select("sentence_id", "company", "year", "text", F.round("inclusion", 4).alias("score"))


@query(_TEXTS + """
    , k AS (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY inclusion DESC, doc_id) AS ri, row_number() OVER (PARTITION BY company, year ORDER BY meritocracy DESC, doc_id) AS rm FROM sy WHERE source = 'investor')
    SELECT company, year, 'investor' AS source, count(*)::INT AS n_chunks, round(avg(inclusion), 6) AS inclusion_mean, round(avg(inclusion) FILTER (ri <= 5), 6) AS inclusion_topk_mean, round(max(inclusion), 6) AS inclusion_max, least(count(*), 5)::INT AS inclusion_k_used,
           round(avg((inclusion >= 0.25)::INT), 6) AS inclusion_fraction_present, round(avg(meritocracy) FILTER (rm <= 5), 6) AS meritocracy_topk_mean, round(avg(meritocracy), 6) AS meritocracy_mean, count(*) < 5 AS thin
    FROM k GROUP BY company, year
""")
def investor_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both poles over the years of a company's filings."""
    rows, by = scored_texts(spark, sf_dir).where("source = 'investor'"), ["company", "year"]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n_chunks"), F.avg("inclusion").alias("inclusion_mean"), F.max("inclusion").alias("inclusion_max"), rollup.presence("inclusion").alias("inclusion_fraction_present"), F.avg("meritocracy").alias("meritocracy_mean"))
    top = lambda c: rollup.topk_mean(rows, by, c, "doc_id").withColumnsRenamed({"raw_topk_mean": f"{c}_topk_mean", "k_used": f"{c}_k_used"})
    out = rollup.same_keys(rollup.same_keys(out, top("inclusion"), by), top("meritocracy").drop("meritocracy_k_used"), by)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes], F.lit("investor").alias("source"), (F.col("n_chunks") < rollup.TOP_K).alias("thin"))


_YEARLY = _TEXTS + """
    , kk AS (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY inclusion DESC, doc_id) AS ri, row_number() OVER (PARTITION BY company, year ORDER BY meritocracy DESC, doc_id) AS rm, row_number() OVER (PARTITION BY company, year ORDER BY control DESC, doc_id) AS rc FROM sy WHERE source = 'careers'),
    yy AS (SELECT company, year, avg(inclusion) FILTER (ri <= 5) AS inclusion, avg(meritocracy) FILTER (rm <= 5) AS meritocracy, avg(control) FILTER (rc <= 5) AS control FROM kk GROUP BY company, year)
"""


def _yearly(rows: DataFrame) -> DataFrame:
    by = ["company", "year"]
    top = lambda c: rollup.topk_mean(rows, by, c, "doc_id").select(*by, F.col("raw_topk_mean").alias(c))
    return rollup.same_keys(rollup.same_keys(top("inclusion"), top("meritocracy"), by), top("control"), by)


@query(_YEARLY + """
    , st AS (SELECT *, lag(inclusion) OVER (PARTITION BY company ORDER BY year) - inclusion AS fall, arg_min(year, row(-inclusion, year)) OVER (PARTITION BY company) AS peak FROM yy)
    SELECT company, any_value(peak) AS peak_year, coalesce(min(year) FILTER (inclusion >= 0.2), min(year)) AS first_year, max(year) AS latest_year, arg_min(year, row(-fall, year)) FILTER (year > peak AND fall > 0) AS retraction_year FROM st GROUP BY company
""")
def inclusion_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's peak, first substantive year (0.2 or more, else its first), latest year and the year of the largest fall since the peak."""
    y = _yearly(scored_texts(spark, sf_dir).where("source = 'careers'"))
    ends = rollup.peak_and_latest(y, ["company"], "year", "inclusion").select("company", F.col("peak_period").alias("peak_year"), F.col("latest_period").alias("latest_year"))
    first = rollup.first_substantive(y, ["company"], "year", "inclusion", 0.2)
    fall = rollup.largest_drop(y, ["company"], "year", "inclusion").select("company", F.col("retraction_period").alias("retraction_year"))
    return ends.join(first, "company").join(fall, "company").select("company", "peak_year", "first_year", "latest_year", "retraction_year")


def _pattern(p: str) -> str:
    return p.replace("'", "''")


def _highlight_sql(stances: list[tuple]) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(text, '{_pattern(p)}') AND source IN ({', '.join(map(_sql, s))}) THEN {k} END" for k, (_, _, p, s) in enumerate(stances))
    bonus = " ".join(f"WHEN stance = '{n}' AND regexp_matches(text, '{_pattern(p)}') THEN {b}" for n, p, b in classify.BONUS)
    return _TEXTS + f"""
        , ev AS (SELECT * FROM sy QUALIFY row_number() OVER (PARTITION BY company, source, year ORDER BY inclusion DESC, doc_id) <= 5),
        hh AS (SELECT *, unnest(list_filter([{hits}], lambda x: x IS NOT NULL)) AS place FROM ev),
        hs AS (SELECT *, CASE place {' '.join(f"WHEN {k} THEN '{x[0]}'" for k, x in enumerate(stances))} END AS stance FROM hh),
        hb AS (SELECT *, round(inclusion + CASE {bonus} ELSE 0.0 END, 4) AS score FROM hs),
        ho AS (SELECT * FROM hb QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY score DESC, year DESC, place, doc_id) = 1),
        hq AS (SELECT *, row_number() OVER (PARTITION BY stance, company ORDER BY score DESC, doc_id) = 1 AS best FROM ho),
        hr AS (SELECT * FROM hq QUALIFY row_number() OVER (PARTITION BY stance ORDER BY best DESC, score DESC, doc_id) <= 3)
        SELECT stance, row_number() OVER (PARTITION BY stance ORDER BY score DESC, doc_id)::INT AS pick, substr(sha256(concat(company, ':', year, ':', substr(text, 1, 80))), 1, 12) AS highlight_id, company, year, source, text, score FROM hr
    """


def stance_quotes(rows: DataFrame, stances: list[tuple]) -> DataFrame:
    """stance, pick, highlight_id, company, year, source, text, score: three quotes of each stance, of different companies first.

    ``rows`` (company, source, year, doc_id, text, inclusion); the five best of each company's year are looked through. Of texts that begin with the same 100 characters
    the best counts, for one stance.
    """
    best = rollup.ranked(rows, ["company", "source", "year"], "inclusion", "doc_id", rollup.TOP_K)
    found = classify.stance_hits(best.select("doc_id", "company", "source", "year", "text", "inclusion"), stances)
    place = F.array_position(F.array(*[F.lit(s[0]) for s in stances]), F.col("stance"))
    scored = found.withColumns({"score": F.round(classify.with_bonus(F.col("inclusion"), F.col("stance"), F.col("text")), 4), "place": place})
    once = first_per(scored, [F.left("text", F.lit(100))], [F.desc("score"), F.desc("year"), "place", "doc_id"])
    picked = curate.quota_pick(once, "stance", "company", "score", "doc_id", 3)
    key = F.left(F.sha2(F.concat_ws(":", "company", F.col("year").cast("string"), F.left("text", F.lit(80))), 256), F.lit(12))
    return picked.select("stance", "pick", key.alias("highlight_id"), "company", "year", "source", "text", "score")


@query(_highlight_sql(classify.PERFORMANCE_STANCES))
def performance_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stance_quotes(scored_texts(spark, sf_dir), classify.PERFORMANCE_STANCES)


@query(_highlight_sql(classify.DEI_STANCES))
def dei_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stance_quotes(scored_texts(spark, sf_dir), classify.DEI_STANCES)


def _rank_sql(x: str, y: str, name: str) -> str:
    avg = lambda c: f"rank() OVER (PARTITION BY company ORDER BY {c}) + (count(*) OVER (PARTITION BY company, {c}) - 1) / 2.0"
    return f"{name} AS (SELECT company, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(a, b), 3) END AS r FROM (SELECT company, {avg(x)} AS a, {avg(y)} AS b FROM yy) GROUP BY company)"


def stance_checks(rows: DataFrame, high: float = 0.2) -> DataFrame:
    """company, n years, rank correlations of inclusion with meritocracy and control, and how many absent texts score above ``high``."""
    y = _yearly(rows)
    pair = lambda c: spearman(y, ["company"], "inclusion", c).select("company", "n", F.col("spearman").alias(f"inclusion_{c}_spearman"))
    absent = rows.groupBy("company").agg(F.count_if((F.col("register") == "absent") & (F.col("inclusion") > high)).alias("absent_count"))
    return pair("meritocracy").join(pair("control").drop("n"), "company").join(absent, "company")


@query(_YEARLY + f"""
    , {_rank_sql('inclusion', 'meritocracy', 'm')}, {_rank_sql('inclusion', 'control', 'c')}, a AS (SELECT company, count(*) FILTER (register = 'absent' AND inclusion > 0.2) AS absent_count FROM kk GROUP BY company)
    SELECT company, m.n, m.r AS inclusion_meritocracy_spearman, c.r AS inclusion_control_spearman, absent_count FROM m JOIN c USING (company) JOIN a USING (company)
""")
def stance_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the poles and the control go together over the years, and how often a text without register scores high."""
    out = stance_checks(scored_texts(spark, sf_dir).where("source = 'careers'"))
    return out.withColumns({c: F.round(c, 3) for c in ("inclusion_meritocracy_spearman", "inclusion_control_spearman")})


@query()
def stance_validation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-sided p of each correlation of ``stance_validation``."""
    p = F.udf(p_value, "double")
    out = stance_checks(scored_texts(spark, sf_dir).where("source = 'careers'"))
    return out.select("company", "n", *[F.round(p(f"inclusion_{c}_spearman", "n"), 3).alias(f"inclusion_{c}_p") for c in ("meritocracy", "control")])


@query(_YEARLY + "SELECT company, chunk_id, year, round(inclusion, 3) AS inclusion, left(text, 160) AS text FROM kk WHERE register = 'absent' AND inclusion > 0.2 QUALIFY row_number() OVER (PARTITION BY company ORDER BY year, chunk_id) <= 20")
def absent_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty absent texts of each company that score above 0.20, as the report shows them."""
    rows = scored_texts(spark, sf_dir).where("source = 'careers' and register = 'absent' and inclusion > 0.2")
    first = rows.withColumn("n", F.row_number().over(rollup.Window.partitionBy("company").orderBy("year", "chunk_id"))).where("n <= 20")
    return first.select("company", "chunk_id", "year", F.round("inclusion", 3).alias("inclusion"), F.left("text", F.lit(160)).alias("text"))


@query(_TEXTS + """
    SELECT company, count(*) FILTER (source = 'investor') = 0 AS careers_only, count(*) FILTER (register <> 'absent') > 0 AS has_register, count(*) FILTER (greatest(inclusion, meritocracy) >= 0.25) > 0 AS has_salience,
           count(DISTINCT year) FILTER (source = 'careers') >= 2 AS two_points, count(*) FILTER (source = 'careers' AND inclusion >= 0.3) > 0 AS has_quote FROM sy GROUP BY company
""")
def view_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which views a company is shown in: careers pages only, a register, a salient text, two years to draw a line, a quote."""
    careers = F.col("source") == "careers"
    return scored_texts(spark, sf_dir).groupBy("company").agg(
        (F.count_if(~careers) == 0).alias("careers_only"), (F.count_if(F.col("register") != "absent") > 0).alias("has_register"), (F.count_if(F.greatest("inclusion", "meritocracy") >= 0.25) > 0).alias("has_salience"),
        (F.countDistinct(F.when(careers, F.col("year"))) >= 2).alias("two_points"), (F.count_if(careers & (F.col("inclusion") >= 0.3)) > 0).alias("has_quote"),
    )
