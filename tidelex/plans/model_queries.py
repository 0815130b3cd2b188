"""Queries whose labels and vectors come from models that are asked cache first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.catalog import query
from tidelex.functions.classify import REGISTERS, STANCES
from tidelex.functions.text import is_english
from tidelex.operators.models import embedded, labelled, labelled_by
from tidelex.operators.scoring import Dedup, axis_report, exact_dedup, near_dedup, stance_report
from tidelex.plans.bindings import CHUNK_LABELS, EMBEDDER, LABELLER, MODEL_SQL, REGISTER_MODEL, STANCE_MODEL, VECTOR, analysed, chunks, sentence_axes, table
from tidelex.plans.text_queries import ENGLISH_SQL
from tidelex.storage import kept, scratch

COMPARED = ["altruism", "control"]
NEAR = 0.8


@query(f"SELECT doc_id, {VECTOR.format('text')} AS embedding FROM documents")
def cached_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of every document, each different text asked for once."""
    rows = embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), EMBEDDER, scratch(spark, "embeddings"))
    return rows.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))


@query(MODEL_SQL + "SELECT doc_id, label, register, stance FROM mc")
def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, register and stance of every chunk as models name them; what is none of the known ones becomes the default."""
    rows, cache = chunks(spark, sf_dir).where("text is not null").select("doc_id", "chunk_id", F.col("company").alias("heading"), "text"), scratch(spark, "labels")
    models = [(LABELLER, CHUNK_LABELS, "navigation_junk", "label"), (REGISTER_MODEL, REGISTERS, "absent", "register"), (STANCE_MODEL, STANCES, "neutral", "stance")]
    rows = labelled_by(rows, models, cache)
    return rows.select("doc_id", "label", "register", "stance")


_AXIS = MODEL_SQL + rf"""
    , m AS (SELECT * FROM mc WHERE label = 'mission_brand' QUALIFY row_number() OVER (PARTITION BY company, text ORDER BY chunk_id) = 1),
    cl AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM m),
    pa AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?…])\s+([A-Z"''(])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda s: trim(s)), lambda s: len(string_split(s, ' ')) >= 6) AS many FROM cl),
    pb AS (SELECT *, CASE WHEN len(many) > 0 THEN many WHEN len(string_split(t, ' ')) >= 6 THEN [t] ELSE [] END AS ss FROM pa),
    se AS (SELECT company, year, chunk_id, heading, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS position FROM pb),
    s1 AS (SELECT * FROM se QUALIFY row_number() OVER (PARTITION BY company, year, text ORDER BY chunk_id, position) = 1),
    every AS (
        SELECT 'chunk' AS level, company, year, chunk_id AS id, heading, text FROM m
        UNION ALL SELECT 'sentence', company, year, substr(sha256(concat_ws('|', chunk_id, position::VARCHAR, text)), 1, 16), heading, text FROM s1
    ),
    ve AS (SELECT *, {VECTOR.format('text')} AS e FROM every),
    vu AS (SELECT * EXCLUDE e, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM ve),
    sc AS (SELECT axis, level, company, year, id, heading, text, list_inner_product(u, vector) AS score FROM vu, bx WHERE axis IN ('altruism', 'control')),
    rk AS (SELECT *, row_number() OVER (PARTITION BY axis, level, company, year ORDER BY score DESC, id)::INT AS rank FROM sc),
    yr AS (SELECT axis, level, company, year, avg(score) FILTER (rank <= 5) AS m, least(count(*), 5)::INT AS k_used, count(*)::INT AS n_chunks FROM rk GROUP BY ALL),
    zs AS (SELECT *, CASE WHEN stddev_pop(m) OVER g = 0 THEN 0 ELSE (m - avg(m) OVER g) / stddev_pop(m) OVER g END AS z FROM yr WINDOW g AS (PARTITION BY axis, level, company)),
    ys AS (SELECT DISTINCT company, year FROM m), pv AS (SELECT *, lag(year) OVER (PARTITION BY company ORDER BY year) AS before FROM ys),
    cu AS (SELECT * FROM vu WHERE level = 'chunk'),
    hit AS (SELECT DISTINCT a.id FROM cu a JOIN pv p ON a.company = p.company AND a.year = p.year JOIN cu b ON b.company = p.company AND b.year = p.before WHERE list_inner_product(a.u, b.u) >= {NEAR}),
    cf AS (SELECT c.company, c.year, CASE WHEN any_value(p.before) IS NOT NULL THEN avg((h.id IS NOT NULL)::INT) END AS f FROM cu c JOIN pv p USING (company, year) LEFT JOIN hit h ON c.id = h.id GROUP BY c.company, c.year)
"""


def _axis(spark: SparkSession, sf_dir: str, dedup: Dedup) -> tuple[DataFrame, DataFrame]:
    cache = scratch(spark, "models")
    axes = sentence_axes(spark, sf_dir, f"{cache}/vectors").where(F.col("axis").isin(COMPARED))
    return axis_report(analysed(spark, sf_dir, f"{cache}/labels", ["mission_brand"]), axes, EMBEDDER, f"{cache}/vectors", dedup, NEAR)


def _series(rows: DataFrame) -> DataFrame:
    return rows.select("axis", "level", "company", "year", F.round("raw_topk_mean", 6).alias("raw_topk_mean"), "k_used", "n_chunks", F.round("zscore", 6).alias("zscore"), F.round("carried_forward_frac", 6).alias("carried_forward_frac"))


@query(_AXIS + "SELECT axis, level, company, year, round(m, 6) AS raw_topk_mean, k_used, n_chunks, round(z, 6) AS zscore, CASE WHEN level = 'chunk' THEN round(f, 6) END AS carried_forward_frac FROM zs LEFT JOIN cf USING (company, year)")
def axis_report_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels of every axis over labelled, embedded texts, those that repeat within a company once."""
    return _series(_axis(spark, sf_dir, exact_dedup)[0])


@query(_AXIS + "SELECT axis, level, company, year, rank, text, heading, round(score, 4) AS score FROM rk WHERE rank <= 5")
def axis_report_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts behind ``axis_report_series``, with heading and score."""
    return _axis(spark, sf_dir, exact_dedup)[1]


@query()
def axis_report_near_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``axis_report_series``, near duplicates of a company once."""
    return _series(_axis(spark, sf_dir, near_dedup)[0])


_STANCE = MODEL_SQL + rf"""
    , an AS (SELECT * FROM mc WHERE label IN ('mission_brand', 'benefits_perks')),
    en AS ({ENGLISH_SQL}),
    rw AS (SELECT company, year, count(*)::INT AS n_chunks_raw FROM an GROUP BY company, year),
    st AS (SELECT an.* FROM an JOIN en USING (doc_id) WHERE english QUALIFY row_number() OVER (PARTITION BY company, year, text ORDER BY chunk_id) = 1),
    sv AS (SELECT *, {VECTOR.format('text')} AS e FROM st),
    su AS (SELECT * EXCLUDE e, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM sv),
    sw AS (SELECT su.* EXCLUDE u, list_inner_product(u, i.vector) AS inclusion, list_inner_product(u, m.vector) AS meritocracy FROM su, (FROM bx WHERE axis = 'inclusion') i, (FROM bx WHERE axis = 'meritocracy') m),
    sd AS (SELECT *, inclusion - meritocracy AS stance_diff, greatest(inclusion, meritocracy) AS salience FROM sw),
    sr AS (
        SELECT *, row_number() OVER (w ORDER BY inclusion DESC, chunk_id) AS ri, row_number() OVER (w ORDER BY meritocracy DESC, chunk_id) AS rm, row_number() OVER (w ORDER BY salience DESC, chunk_id) AS rs,
               row_number() OVER (w ORDER BY stance_diff DESC, chunk_id) AS hi, row_number() OVER (w ORDER BY stance_diff, chunk_id) AS lo,
               row_number() OVER (w ORDER BY register NOT IN ('meritocracy', 'civilizational_mission'), register <> 'civilizational_mission', salience DESC, chunk_id) AS rc
        FROM sd WINDOW w AS (PARTITION BY company, year)
    )
"""
_SCORES = ["inclusion", "meritocracy", "stance_diff", "salience"]


def _stance(spark: SparkSession, sf_dir: str, dedup: Dedup) -> tuple[DataFrame, DataFrame]:
    cache = scratch(spark, "models")
    axes = kept(sentence_axes(spark, sf_dir, f"{cache}/vectors"), "axes")
    rows = analysed(spark, sf_dir, f"{cache}/labels", ["mission_brand", "benefits_perks"])
    rows = labelled(rows, REGISTER_MODEL, f"{cache}/labels", REGISTERS, "absent", "register").withColumn("wanted", is_english(F.col("text")))
    rows = kept(rows, "chunks")
    series, _ = axis_report(rows.where("label = 'mission_brand'"), axes.where("axis = 'control'"), EMBEDDER, f"{cache}/vectors", dedup, NEAR)
    return stance_report(rows, axes, series.where("level = 'sentence'"), EMBEDDER, f"{cache}/vectors", dedup=dedup)


_CONTROL = _AXIS.removeprefix(MODEL_SQL)


@query(_STANCE + _CONTROL + f"""
    , ct AS (SELECT DISTINCT company, year, text FROM st), cy AS (SELECT DISTINCT company, year FROM ct), cp AS (SELECT *, lag(year) OVER (PARTITION BY company ORDER BY year) AS before FROM cy),
    ch AS (SELECT t.company, t.year, avg((o.text IS NULL)::INT) AS churn, count(*) AS n_texts FROM ct t JOIN cp USING (company, year) LEFT JOIN ct o ON o.company = t.company AND o.year = cp.before AND o.text = t.text GROUP BY t.company, t.year),
    ag AS (
        SELECT company, year, count(*)::INT AS n_chunks, avg(inclusion) AS inclusion_mean, avg(inclusion) FILTER (ri <= 5) AS inclusion_topk_mean, max(inclusion) AS inclusion_max, avg((inclusion >= 0.25)::INT) AS inclusion_present,
               avg(meritocracy) AS meritocracy_mean, avg(meritocracy) FILTER (rm <= 5) AS meritocracy_topk_mean, max(meritocracy) AS meritocracy_max, avg((meritocracy >= 0.25)::INT) AS meritocracy_present,
               max(stance_diff) AS stance_max, min(stance_diff) AS stance_min, avg(stance_diff) AS stance_mean, avg(salience) FILTER (rs <= 5) AS salience_topk_mean,
               {', '.join(f"count(*) FILTER (register = '{r}') AS register_{r}" for r in REGISTERS)}
        FROM sr GROUP BY company, year
    )
    SELECT ag.company, ag.year, ag.n_chunks, {', '.join(f'round({c}, 6) AS {c}' for c in ('inclusion_mean', 'inclusion_topk_mean', 'inclusion_max', 'inclusion_present', 'meritocracy_mean', 'meritocracy_topk_mean', 'meritocracy_max', 'meritocracy_present', 'stance_max', 'stance_min', 'stance_mean', 'salience_topk_mean'))},
           {', '.join(f'register_{r}' for r in REGISTERS)}, n_chunks_raw, n_texts AS n_unique_texts, round(churn, 6) AS text_churn, round(c.m, 6) AS control_raw_topk_mean, least(ag.n_chunks, 5)::INT AS k_used
    FROM ag JOIN rw USING (company, year) JOIN ch USING (company, year) LEFT JOIN (FROM zs WHERE axis = 'control' AND level = 'sentence') c USING (company, year)
""")  # fmt: skip
def stance_report_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two poles, registers, churn and control of a company's years over English texts, those that repeat within a year once."""
    out = _stance(spark, sf_dir, exact_dedup)[0]
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(_STANCE + """
    , kd AS (
        SELECT 'inclusion' AS kind, ri AS rank, * FROM sr WHERE ri <= 5 UNION ALL SELECT 'meritocracy', rm, * FROM sr WHERE rm <= 5 UNION ALL SELECT 'stance_max', hi, * FROM sr WHERE hi = 1
        UNION ALL SELECT 'stance_min', lo, * FROM sr WHERE lo = 1 UNION ALL SELECT 'counter', rc, * FROM sr WHERE rc = 1 AND register IN ('meritocracy', 'civilizational_mission')
    )
    SELECT company, year, kind, rank::INT AS rank, left(text, 400) AS text, heading, register, round(inclusion, 4) AS inclusion, round(meritocracy, 4) AS meritocracy, round(stance_diff, 4) AS stance_diff, round(salience, 4) AS salience FROM kd
""")
def stance_report_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts behind ``stance_report_series``: the best of either pole, the envelope's ends and what runs counter."""
    return _stance(spark, sf_dir, exact_dedup)[1]


@query()
def stance_report_near_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``stance_report_series``, near duplicates of a year once."""
    out = _stance(spark, sf_dir, near_dedup)[0]
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])
