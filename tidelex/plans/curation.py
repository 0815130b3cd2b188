"""Phrases over time, highlights with quotas, timelines, presence and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.catalog import query
from tidelex.operators import curate
from tidelex.operators.joins import matching_patterns
from tidelex.operators.rollup import best_row
from tidelex.plans.bindings import CHUNK_SQL, SQL, chunks, scored
from tidelex.plans.text_queries import _REGISTER, _SENTENCES, register_counts, register_rows, sentence_rows

#: A pattern table over words of the fixtures.
PATTERNS = [("praise", "(?i)\\b(?:license|copyright)\\b"), ("abuse", "(?i)\\b(?:idiot|scum|trash)\\b"), ("copula", "(?i)\\b(?:ist|est|is)\\b"), ("article", "(?i)\\b(?:der|las|les)\\b")]
def _word_sql(words: str) -> str:
    """RE2 knows ASCII word boundaries only, so the oracle spells them out."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    return f"regexp_matches(sentence, '(?i)(?:^|{edge})(?:{words})(?:{edge}|$)')"


def _patterns(spark: SparkSession) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("stance"), F.lit(b).alias("pattern")) for a, b in PATTERNS]))
    return spark.range(1).select(rows.alias("r")).select("r.*")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentence_rows(spark, sf_dir)
    score = F.round(F.length("sentence") / (F.length("sentence") + 200.0), 4)
    return matching_patterns(s, "sentence", _patterns(spark)).withColumns({"score": score, "spot": F.format_string("%012d-%06d", "doc_id", "position")})


_HITS = _SENTENCES + f"""
    , tagged AS (
        SELECT *, unnest([CASE WHEN {_word_sql("license|copyright")} THEN 'praise' END, CASE WHEN {_word_sql("idiot|scum|trash")} THEN 'abuse' END,
                          CASE WHEN {_word_sql("ist|est|is")} THEN 'copula' END, CASE WHEN {_word_sql("der|las|les")} THEN 'article' END]) AS stance FROM sent
    ),
    hit AS (SELECT *, round(length(sentence) / (length(sentence) + 200.0), 4) AS score, printf('%012d-%06d', doc_id, position) AS spot FROM tagged WHERE stance IS NOT NULL)
"""


@query(_HITS + "SELECT stance AS term, min(year) AS first_year, max(year) AS last_year, max(score) AS max_score, count(*) AS n_hits, substr(arg_min(sentence, row(-score, spot)), 1, 200) AS example FROM hit GROUP BY stance")
def pattern_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last year, best score and example of each pattern."""
    return curate.term_tracking(_hits(spark, sf_dir), "stance", "year", "score", "sentence", "spot")


@query(_SENTENCES + r"""
    , m AS (SELECT *, unnest(regexp_extract_all(sentence, '(?i)\b(?:licen|copyr|apach)[a-z]*\b')) AS raw, length(sentence) / (length(sentence) + 200.0) AS score, printf('%012d-%06d', doc_id, position) AS spot FROM sent)
    SELECT lower(raw) AS term, min(year) AS first_year, max(year) AS last_year, round(max(score), 4) AS max_score, count(*) AS n_hits, substr(arg_min(sentence, row(-score, spot)), 1, 200) AS example FROM m GROUP BY 1
""")
def term_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by stem: each lower-cased match is a term of its own."""
    s = sentence_rows(spark, sf_dir).withColumns({"score": F.length("sentence") / (F.length("sentence") + 200.0), "spot": F.format_string("%012d-%06d", "doc_id", "position")})
    found = curate.found_terms(s, "sentence", r"(?i)\b(?:licen|copyr|apach)[a-z]*\b")
    return curate.term_tracking(found, "term", "year", "score", "sentence", "spot").withColumn("max_score", F.round("max_score", 4))


@query(_HITS + """
    , once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stance, substr(sentence, 1, 100) ORDER BY score DESC, year DESC, spot) AS n FROM hit) WHERE n = 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY stance, company ORDER BY score DESC, spot) = 1 AS best FROM once),
    q AS (SELECT *, row_number() OVER (PARTITION BY stance ORDER BY best DESC, score DESC, spot) AS n2 FROM b)
    SELECT stance, company, year, score, spot, row_number() OVER (PARTITION BY stance ORDER BY score DESC, spot)::INT AS pick FROM q WHERE n2 <= 3
""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quotes per stance, the best of each company before second ones, no beginning twice."""
    hits = _hits(spark, sf_dir)
    once = curate.first_per(hits, ["stance", F.substring("sentence", 1, 100)], [F.desc("score"), F.desc("year"), "spot"])
    return curate.quota_pick(once, "stance", "company", "score", "spot").select("stance", "company", "year", "score", "spot", "pick")


_EXCLUDED = "(('src1', 'abuse'), ('src2', 'copula'))"


@query(_HITS + f"SELECT company, stance, count(*) AS n FROM hit WHERE (company, stance) NOT IN {_EXCLUDED} GROUP BY ALL")
def stance_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits but for an exclusion matrix of company and stance."""
    matrix = F.explode(F.array(*[F.struct(F.lit(a).alias("company"), F.lit(b).alias("stance")) for a, b in (("src1", "abuse"), ("src2", "copula"))]))
    table = spark.range(1).select(matrix.alias("r")).select("r.*")
    return _hits(spark, sf_dir).join(F.broadcast(table), ["company", "stance"], "left_anti").groupBy("company", "stance").agg(F.count(F.lit(1)).alias("n"))


_SCORED_REGISTER = _REGISTER + ", sc AS (SELECT *, round(length(text) / (length(text) + 1000.0), 4) AS score FROM reg)"


def _register_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register_rows(spark, sf_dir).withColumn("score", F.round(F.length("text") / (F.length("text") + 1000.0), 4))


@query(_SCORED_REGISTER + """
    , best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, register, year ORDER BY score DESC, doc_id) AS n FROM sc WHERE register <> 'absent') WHERE n = 1),
    ends AS (SELECT *, min(year) OVER g AS lo, max(year) OVER g AS hi FROM best WINDOW g AS (PARTITION BY company, register)),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, substr(text, 1, 80) ORDER BY year, register, doc_id) AS m FROM ends WHERE year = lo OR year = hi) WHERE m = 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY year, register, doc_id)::INT AS place FROM once)
    SELECT company, register, year, doc_id, score, place FROM placed WHERE place <= 8
""")
def register_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each register a company used the best quote of its first and last year."""
    rows = _register_scores(spark, sf_dir).where("register <> 'absent'")
    return curate.first_and_last(rows, ["company"], "register", "year", "score", "text", "doc_id").select("company", "register", "year", "doc_id", "score", "place")


@query(_SCORED_REGISTER + "SELECT company, year, arg_min(doc_id, row(-score, doc_id)) AS doc_id, max(score) AS score FROM sc GROUP BY company, year")
def best_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best quote of each company and year."""
    rows = _register_scores(spark, sf_dir)
    out = rows.groupBy("company", "year").agg(best_row(["doc_id", "score"], "score", "doc_id").alias("q"))
    return out.select("company", "year", "q.*")


@query(_SCORED_REGISTER + """
    SELECT company, coalesce(arg_min(doc_id, row(-score, doc_id)) FILTER (register = 'civilizational_mission'), arg_min(doc_id, row(-score, doc_id)) FILTER (register IN ('meritocracy', 'civilizational_mission'))) AS counter_id FROM sc GROUP BY company
""")
def counter_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best counter-register quote: of the civilizational register if there is one, else of any counter register."""
    best = lambda names: F.min_by("doc_id", F.when(F.col("register").isin(names), F.struct(-F.col("score"), F.col("doc_id"))))
    out = _register_scores(spark, sf_dir).groupBy("company").agg(best(["civilizational_mission"]).alias("first"), best(["meritocracy", "civilizational_mission"]).alias("second"))
    return out.select("company", F.coalesce("first", "second").alias("counter_id"))


@query(_REGISTER + """
    SELECT company, year, round(coalesce(count(*) FILTER (register IN ('explicit_demographic', 'structural_process')), 0) / count(*), 6) AS affirming, round(count(*) FILTER (register NOT IN ('explicit_demographic', 'structural_process', 'meritocracy')) / count(*), 6) AS neutral,
           round(count(*) FILTER (register = 'meritocracy') / count(*), 6) AS elite FROM reg GROUP BY company, year
""")
def stance_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of stances that registers stand for, neutral by default."""
    hint = F.when(F.col("register").isin("explicit_demographic", "structural_process"), "affirming").when(F.col("register") == "meritocracy", "elite")
    rows = register_rows(spark, sf_dir).withColumn("stance", F.coalesce(hint, F.lit("neutral")))
    share = lambda x: F.round(F.avg((F.col("stance") == x).cast("double")), 6).alias(x)
    return rows.groupBy("company", "year").agg(share("affirming"), share("neutral"), share("elite"))


@query(SQL + "SELECT vec_id, company, year, round(score, 4) AS score FROM s WHERE axis = 'inclusion' AND score > 0.2 AND vec_id % 2 = 1 ORDER BY vec_id LIMIT 20")
def absent_but_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the register absent (here: odd ids) with a score above 0.20; the report shows the first 20."""
    rows = scored(spark, sf_dir, "inclusion").where("vec_id % 2 = 1 AND score > 0.2")
    return rows.select("vec_id", "company", "year", F.round("score", 4).alias("score")).orderBy("vec_id").limit(20)


@query(SQL + "SELECT vec_id, company, year, round(score, 4) AS score, count(*) OVER (PARTITION BY company) AS n_rows FROM s WHERE axis = 'inclusion' AND score > 0.2 AND vec_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY company ORDER BY vec_id) <= 20")
def absent_but_high_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 rows of each company, as in ``absent_but_high``, with the count of all its rows."""
    rows = scored(spark, sf_dir, "inclusion").where("vec_id % 2 = 1 AND score > 0.2")
    counts = rows.groupBy("company").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("company").orderBy("vec_id"))).where("place <= 20").join(counts, "company").select("vec_id", "company", "year", F.round("score", 4).alias("score"), "n_rows")


@query(CHUNK_SQL + "SELECT doc_id FROM c ORDER BY sha256('42|' || doc_id), doc_id LIMIT 80")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 documents to label by hand, the same on every run."""
    return curate.seeded_sample(chunks(spark, sf_dir), "doc_id", 80).select("doc_id")


@query(CHUNK_SQL + """
    , e AS (SELECT doc_id, company, CASE WHEN year < 2015 THEN 'early' WHEN year < 2020 THEN 'middle' ELSE 'late' END AS era, sha256('42|' || doc_id) AS h FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY company, era ORDER BY h, doc_id) AS n, (SELECT count(*) FROM (SELECT DISTINCT company, era FROM e)) AS b FROM e)
    SELECT doc_id, company, era FROM n ORDER BY n > 120 // b, h, doc_id LIMIT 120
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelex.functions.classify import era

    rows = chunks(spark, sf_dir).select("doc_id", "company", era(F.col("year")).alias("era"))
    return curate.stratified_sample(rows, ["company", "era"], "doc_id", 120).select("doc_id", "company", "era")


@query(_REGISTER + "SELECT company, min(year) AS coverage_start, max(year) AS coverage_end, count(*) AS n_years, count(*) FILTER (n_chunks < 5) AS thin_years FROM n GROUP BY company")
def coverage_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = register_counts(spark, sf_dir)
    return n.groupBy("company").agg(F.min("year").alias("coverage_start"), F.max("year").alias("coverage_end"), F.count(F.lit(1)).alias("n_years"), F.count_if(F.col("n_chunks") < 5).alias("thin_years"))
