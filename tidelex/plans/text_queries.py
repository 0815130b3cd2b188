"""Sentences, n-grams, cascades and labels over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.catalog import query
from tidelex.functions import classify, language, text
from tidelex.operators import rollup
from tidelex.operators.dedup import first_per, near_duplicates_removed
from tidelex.operators.joins import shares_ngram
from tidelex.plans.bindings import CHUNK_SQL, chunks, table
from tidelex.sources import review_lines

_SENTENCES = CHUNK_SQL + r"""
    , clean AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM c),
    parts AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?…])\s+([A-Z"''(])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda s: trim(s)), lambda s: len(string_split(s, ' ')) >= 6) AS kept FROM clean),
    chosen AS (SELECT *, CASE WHEN len(kept) > 0 THEN kept WHEN len(string_split(t, ' ')) >= 6 THEN [t] ELSE [] END AS ss FROM parts),
    sent AS (SELECT chunk_id, doc_id, company, year, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS position FROM chosen)
"""


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.select("chunk_id", "doc_id", "company", "year", F.posexplode(text.sentences(F.col("text"))).alias("position", "sentence"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> ''))::INT AS word_count FROM documents")
def squeezed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.squeeze(F.col("text")).alias("clean"), text.word_count(F.col("text")).alias("word_count"))


@query(CHUNK_SQL + "SELECT doc_id, chunk_id FROM c")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "chunk_id")


@query(_SENTENCES + "SELECT substr(sha256(concat_ws('|', chunk_id, position::VARCHAR, sentence)), 1, 16) AS sentence_id, chunk_id, year, position::INT AS position, sentence FROM sent")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentence_rows(spark, sf_dir)
    return s.select(text.short_id(F.col("chunk_id"), F.col("position"), F.col("sentence")).alias("sentence_id"), "chunk_id", "year", "position", "sentence")


@query(_SENTENCES + """
    SELECT year, sentence, doc_id, position::INT AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY year, sentence ORDER BY doc_id, position) AS n FROM sent) WHERE n = 1
""")
def sentences_once_a_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per(sentence_rows(spark, sf_dir), ["year", "sentence"], ["doc_id", "position"]).select("year", "sentence", "doc_id", "position")


@query(r"""
    WITH t AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents),
    a AS (SELECT *, list_filter(w, lambda x: regexp_matches(x, '^\p{L}')) AS alpha FROM t)
    SELECT doc_id, NOT regexp_matches(text, '[.!?…]') AND len(w) >= 6 AND len(alpha) > 0 AND len(list_filter(alpha, lambda x: regexp_matches(x, '^\p{Lu}'))) >= len(alpha) * 0.6 AS link_list FROM a
""")
def link_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.is_link_list(F.col("text")).alias("link_list"))


_GRAMS = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9'']+)', 1) AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5))
"""


@query(_GRAMS + "SELECT doc_id, count(*) AS n_grams FROM g GROUP BY doc_id")
def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 5-word sequences of each document that has any."""
    enough = F.regexp_count(F.lower("text"), F.lit("[a-z0-9']+")) >= 5  # a filter on n_grams would build the sequences twice
    return table(spark, sf_dir, "documents").where(enough).select("doc_id", F.size(text.ngrams(F.col("text"), 5)).cast("long").alias("n_grams"))


@query(_GRAMS + r"""
    , bw AS (SELECT regexp_extract_all(lower(text), '([a-z0-9'']+)', 1) AS w FROM benchmark),
    bg AS (SELECT DISTINCT array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT w, unnest(generate_series(1, len(w) - 4)) AS i FROM bw WHERE len(w) >= 5))
    SELECT DISTINCT doc_id FROM g WHERE gram IN (SELECT gram FROM bg)
""")
def shared_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a 5-word sequence with the benchmark."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.ngrams(F.col("text"), 5).alias("grams"))
    b = table(spark, sf_dir, "benchmark").select(text.ngrams(F.col("text"), 5).alias("grams"))
    return shares_ngram(d, "doc_id", "grams", b, "grams")


def _votes(language: str) -> str:
    listed = ", ".join(f"'{w}'" for w in text.STOP_WORDS[language])
    return f"len(list_filter(w, lambda x: list_contains([{listed}], x)))"


ENGLISH_SQL = rf"""
    WITH t AS (SELECT doc_id, trim(text) AS t FROM documents),
    r AS (SELECT doc_id, t, CASE WHEN length(t) = 0 THEN 1.0 ELSE length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) / length(t) END AS a, string_split(lower(trim(regexp_replace(t, '\s+', ' ', 'g'))), ' ') AS w FROM t),
    v AS (SELECT *, {_votes('en')} AS own, greatest({_votes('de')}, {_votes('fr')}, {_votes('es')}) AS others FROM r)
    SELECT doc_id, CASE WHEN length(t) < 40 THEN true WHEN a < 0.85 THEN false WHEN own = 0 AND others = 0 THEN a >= 0.92 ELSE own >= others END AS english FROM v
"""


@query(ENGLISH_SQL)
def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.is_english(F.col("text")).alias("english"))


@query()
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a profile that is learned from the documents that have labels, and whether it passes as English."""
    docs = table(spark, sf_dir, "documents")
    profile = language.learn(docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"))
    found = docs.select("doc_id", "text", language.language_of(F.col("text"), profile).alias("language"))  # asked once for both columns
    return found.select("doc_id", "language", language.passes_as_english(F.col("text"), F.col("language")).alias("english"))


#: A cascade over words that occur in the fixtures, with the shape of the shipped ones.
FIXTURE_RULES = [
    classify.Rule("civilizational_mission", pattern=r"(?i)\b(?:idiot|scum)\b"),
    classify.Rule("meritocracy", (("license", "copyright"),)),
    classify.Rule("absent", (("the", "der", "que"),), negate=True),
    classify.Rule("explicit_demographic", (("with", "mit"), ("this", "ein")), ("@",)),
    classify.Rule("structural_process", (("for", "pour"),)),
    classify.Rule("belonging_culture", (("that", "las"),)),
]
_REGISTER = CHUNK_SQL + r"""
    , reg AS (
        SELECT *, CASE WHEN regexp_matches(text, '(?i)\b(?:idiot|scum)\b') THEN 'civilizational_mission'
            WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'meritocracy'
            WHEN NOT (contains(lower(text), 'the') OR contains(lower(text), 'der') OR contains(lower(text), 'que')) THEN 'absent'
            WHEN (contains(lower(text), 'with') OR contains(lower(text), 'mit')) AND (contains(lower(text), 'this') OR contains(lower(text), 'ein')) AND NOT contains(text, '@') THEN 'explicit_demographic'
            WHEN contains(lower(text), 'for') OR contains(lower(text), 'pour') THEN 'structural_process'
            WHEN contains(lower(text), 'that') OR contains(lower(text), 'las') THEN 'belonging_culture' ELSE 'aspirational_vague' END AS register FROM c
    ),
    n AS (
        SELECT company, year, count(*) AS n_chunks, count(*) FILTER (register = 'explicit_demographic') AS explicit_demographic, count(*) FILTER (register = 'structural_process') AS structural_process,
               count(*) FILTER (register = 'aspirational_vague') AS aspirational_vague, count(*) FILTER (register = 'belonging_culture') AS belonging_culture, count(*) FILTER (register = 'meritocracy') AS meritocracy,
               count(*) FILTER (register = 'civilizational_mission') AS civilizational_mission, count(*) FILTER (register = 'absent') AS absent FROM reg GROUP BY company, year
    )
"""


def register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).withColumn("register", classify.cascade(F.col("text"), FIXTURE_RULES, "aspirational_vague"))


def register_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by = register_rows(spark, sf_dir), ["company", "year"]
    return rollup.label_counts(rows, by, "register", classify.REGISTERS).join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks")), by)


@query(_REGISTER + "SELECT doc_id, register FROM reg")
def registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register_rows(spark, sf_dir).select("doc_id", "register")


@query(CHUNK_SQL + r"""
    SELECT doc_id,
        CASE WHEN text IS NULL THEN NULL
            WHEN regexp_matches(text, '(?i)\b(?:future of the west|the west''?s most important|western (?:tech )?institutions|warfighters?|battlefield|build with consequence|tinker at the margins|technological republic|most important institutions|empower the world''?s most important institutions)\b') THEN 'civilizational_mission'
            WHEN (contains(lower(text), 'judged by outcomes') OR contains(lower(text), 'work will speak for itself') OR contains(lower(text), 'uncompromising engineering') OR contains(lower(text), 'best and the brightest') OR contains(lower(text), 'rigorous hiring standards')) THEN 'meritocracy'
            WHEN (contains(lower(text), 'social or political activism') OR contains(lower(text), 'refuge from division') OR contains(lower(text), 'unrelated to our mission while at work') OR contains(lower(text), 'don''t engage in social') OR contains(lower(text), 'do not engage in social')) THEN 'meritocracy'
            WHEN NOT (contains(lower(text), 'divers') OR contains(lower(text), 'inclus') OR contains(lower(text), 'belong') OR contains(lower(text), 'equity') OR contains(lower(text), 'represent') OR contains(lower(text), 'underrepresented') OR contains(lower(text), 'bias') OR contains(lower(text), 'merit') OR contains(lower(text), 'whole self') OR contains(lower(text), 'women in tech') OR contains(lower(text), 'girl geek') OR contains(lower(text), 'scholarship for women')) THEN 'absent'
            WHEN (contains(lower(text), 'black') OR contains(lower(text), 'latinx') OR contains(lower(text), 'hispanic') OR contains(lower(text), 'lgbtq') OR contains(lower(text), 'veteran') OR contains(lower(text), 'disabilit')) AND (contains(lower(text), 'representation') OR contains(lower(text), 'target') OR contains(lower(text), 'percent') OR contains(lower(text), '%') OR contains(lower(text), 'workforce data') OR contains(lower(text), 'increase')) THEN 'explicit_demographic'
            WHEN (contains(lower(text), 'black') OR contains(lower(text), 'latinx') OR contains(lower(text), 'hispanic') OR contains(lower(text), 'lgbtq') OR contains(lower(text), 'veteran') OR contains(lower(text), 'disabilit')) THEN 'aspirational_vague'
            WHEN contains(lower(text), 'women') AND NOT (contains(lower(text), 'breast cancer') OR contains(lower(text), 'mammograph') OR contains(lower(text), 'patient') OR contains(lower(text), 'screening')) AND (contains(lower(text), 'lean in') OR contains(lower(text), 'partner') OR contains(lower(text), 'encouragement') OR contains(lower(text), 'support to achieve') OR contains(lower(text), 'scholarship') OR contains(lower(text), 'girl geek')) THEN 'aspirational_vague'
            WHEN contains(lower(text), 'women') AND NOT (contains(lower(text), 'breast cancer') OR contains(lower(text), 'mammograph') OR contains(lower(text), 'patient') OR contains(lower(text), 'screening')) AND (contains(lower(text), 'representation') OR contains(lower(text), 'target') OR contains(lower(text), 'percent') OR contains(lower(text), '%')) THEN 'explicit_demographic'
            WHEN (contains(lower(text), 'audit') OR contains(lower(text), 'structured interview') OR contains(lower(text), 'pay gap') OR contains(lower(text), 'promotion process') OR contains(lower(text), 'bias training')) THEN 'structural_process'
            WHEN (contains(lower(text), 'regardless of background') OR contains(lower(text), 'same criteria') OR contains(lower(text), 'don''t lower our standards') OR contains(lower(text), 'best people, period') OR contains(lower(text), 'identity politics') OR contains(lower(text), 'don''t do dei') OR contains(lower(text), 'not identity') OR contains(lower(text), 'meritocracy') OR contains(lower(text), 'merit, not')) THEN 'meritocracy'
            WHEN (contains(lower(text), 'whole self') OR contains(lower(text), 'bring your') OR contains(lower(text), 'culture of') OR contains(lower(text), 'feel welcome')) THEN 'belonging_culture'
            ELSE 'aspirational_vague' END AS register,
        CASE WHEN text IS NULL THEN NULL
            WHEN regexp_matches(text, '(?i)\b(?:future of the west|the west''?s most important|western (?:tech )?institutions|warfighters?|battlefield|build with consequence|tinker at the margins|technological republic|most important institutions|empower the world''?s most important institutions)\b') THEN 'civilizational_mission'
            WHEN (contains(lower(text), 'political activism') OR contains(lower(text), 'refuge from division') OR contains(lower(text), 'apolitical') OR contains(lower(text), 'unrelated to our mission while at work') OR contains(lower(text), 'social or political') OR contains(lower(text), 'don''t engage in social')) THEN 'mission_focus_apolitical'
            WHEN (contains(lower(text), 'judged by outcomes') OR contains(lower(text), 'work will speak for itself') OR contains(lower(text), 'uncompromising engineering') OR contains(lower(text), 'championship team') OR contains(lower(text), 'generous severance') OR contains(lower(text), 'not a family') OR contains(lower(text), 'stunning colleagues') OR contains(lower(text), 'high expectations for performance') OR contains(lower(text), 'faint of heart') OR contains(lower(text), 'dream team')) THEN 'performance_elite'
            WHEN (contains(lower(text), 'scholarship for women') OR contains(lower(text), 'girl geek') OR contains(lower(text), 'women in technology') OR contains(lower(text), 'belonging') OR contains(lower(text), 'whole self') OR contains(lower(text), 'representation') OR contains(lower(text), 'underrepresented') OR contains(lower(text), 'commitment to diversity')) THEN 'affirming_dei'
            WHEN contains(lower(text), 'inclusion') AND (contains(lower(text), 'diversity') OR contains(lower(text), 'belonging') OR contains(lower(text), 'equity')) THEN 'affirming_dei'
            ELSE 'neutral' END AS stance
    FROM c
""")
def shipped_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped register and stance rules over all documents."""
    t = F.col("text")
    return chunks(spark, sf_dir).select("doc_id", classify.register(t).alias("register"), classify.stance(t).alias("stance"))


@query(_REGISTER + "SELECT company, year, n_chunks, explicit_demographic, structural_process, aspirational_vague, belonging_culture, meritocracy, civilizational_mission, absent FROM n")
def register_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register_counts(spark, sf_dir).select("company", "year", "n_chunks", *classify.REGISTERS)


@query(_REGISTER + """
    SELECT company, year, round((explicit_demographic + structural_process + aspirational_vague + belonging_culture) / n_chunks, 6) AS active_share, round(meritocracy / n_chunks, 6) AS meritocracy_share,
           round((meritocracy + civilizational_mission) / n_chunks, 6) AS counter_share FROM n
""")
def register_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"active_share": classify.ACTIVE_REGISTERS, "meritocracy_share": ["meritocracy"], "counter_share": classify.COUNTER_REGISTERS}
    out = rollup.label_shares(register_counts(spark, sf_dir), classify.REGISTERS, "n_chunks", groups)
    return out.select("company", "year", *[F.round(k, 6).alias(k) for k in groups])


@query(_REGISTER + """
    , long AS (
        SELECT company, unnest([1, 2, 3, 4, 5, 6]) AS place, unnest(['explicit_demographic', 'structural_process', 'aspirational_vague', 'belonging_culture', 'meritocracy', 'civilizational_mission']) AS label,
               unnest([explicit_demographic, structural_process, aspirational_vague, belonging_culture, meritocracy, civilizational_mission]) AS value FROM n
    ), tot AS (SELECT company, place, label, sum(value) AS v FROM long GROUP BY ALL),
    sh AS (SELECT *, v / sum(v) OVER (PARTITION BY company) AS share, row_number() OVER (PARTITION BY company ORDER BY v DESC, place) AS n FROM tot)
    SELECT company, CASE WHEN share >= 0.35 THEN label END AS dominant, round(share, 6) AS share FROM sh WHERE n = 1
""")
def dominant_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.dominant_label(register_counts(spark, sf_dir), ["company"], classify.REGISTERS, "")
    return out.select("company", "dominant", F.round("share", 6).alias("share"))


@query(_REGISTER + """
    , long AS (
        SELECT company, year, unnest([1, 2, 3, 4, 5, 6, 7]) AS place, unnest(['explicit_demographic', 'structural_process', 'aspirational_vague', 'belonging_culture', 'meritocracy', 'civilizational_mission', 'absent']) AS label,
               unnest([explicit_demographic, structural_process, aspirational_vague, belonging_culture, meritocracy, civilizational_mission, absent]) AS value FROM n
    )
    SELECT company, year, label, value, (sum(value) OVER w - value)::BIGINT AS lower, (sum(value) OVER w)::BIGINT AS upper FROM long WINDOW w AS (PARTITION BY company, year ORDER BY place)
""")
def register_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.cumulative_stack(register_counts(spark, sf_dir), ["company", "year"], classify.REGISTERS)


_WORDS = r"len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> ''))"
_QUOTED = {k: v.replace("'", "''") for k, v in {"tokens": classify.NAV_TOKENS, "chrome": text.CHROME_START, "place": classify.LOCATION_HEADING, "body": classify.LOCATION_BODY}.items()}


@query(CHUNK_SQL + rf"""
    , n AS (SELECT *, {_WORDS} AS n FROM c),
    m AS (
        SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'benefits_perks' ELSE 'mission_brand' END AS label, CASE doc_id % 4 WHEN 2 THEN 'St. Mary''s, Washington' ELSE 'Our work' END AS heading,
               CASE doc_id % 4 WHEN 0 THEN repeat('Today''s Deals sign in ', n // 10 + 1) || text WHEN 1 THEN 'Well, ' || repeat('gift cards ', n // 5 + 1) || text WHEN 2 THEN text || ' Its population grows.' ELSE text END AS text FROM n
    ),
    k AS (SELECT *, len(regexp_extract_all(text, '{_QUOTED['tokens']}')) / greatest({_WORDS}, 1) AS share FROM m),
    r AS (
        SELECT *, CASE WHEN regexp_matches(text, '{_QUOTED['chrome']}') AND share > 0.08 THEN 'nav chrome prefix' WHEN share > 0.12 THEN 'high nav token fraction'
                       WHEN regexp_matches(trim(heading), '{_QUOTED['place']}') AND regexp_matches(text, '{_QUOTED['body']}') THEN 'location page' END AS reason FROM k WHERE label = 'mission_brand'
    )
    SELECT doc_id, label AS "from", 'navigation_junk' AS "to", reason FROM r WHERE reason IS NOT NULL
""")
def relabel_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shipped relabel rules change, over documents with menus before them, gift cards within and places above."""
    n, kind = text.word_count(F.col("text")), F.col("doc_id") % 4
    menu = F.concat(F.repeat(F.lit("Today's Deals sign in "), (F.floor(n / 10) + 1).cast("int")), "text")
    cards = F.concat(F.lit("Well, "), F.repeat(F.lit("gift cards "), (F.floor(n / 5) + 1).cast("int")), "text")
    body = F.when(kind == 0, menu).when(kind == 1, cards).when(kind == 2, F.concat("text", F.lit(" Its population grows."))).otherwise(F.col("text"))
    heading = F.when(kind == 2, "St. Mary's, Washington").otherwise("Our work")
    label = F.when(F.col("doc_id") % 5 == 4, "benefits_perks").otherwise("mission_brand")
    return classify.change_log(classify.relabelled(chunks(spark, sf_dir).select("doc_id", body.alias("text"), heading.alias("heading"), label.alias("label"))), "doc_id")


@query(CHUNK_SQL + """
    , t AS (SELECT DISTINCT company, year, text FROM c), y AS (SELECT company, year, lag(year) OVER (PARTITION BY company ORDER BY year) AS before FROM (SELECT DISTINCT company, year FROM t))
    SELECT t.company, t.year, count(*) AS n_unique_texts, round(1 - count(o.text) / count(*), 6) AS text_churn
    FROM t JOIN y USING (company, year) LEFT JOIN t o ON o.company = t.company AND o.year = y.before AND o.text = t.text GROUP BY t.company, t.year
""")
def text_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.text_churn(chunks(spark, sf_dir), ["company"], "year", "text").select("company", "year", "n_unique_texts", F.round("text_churn", 6).alias("text_churn"))


@query(CHUNK_SQL + "SELECT doc_id, company, year FROM (SELECT *, row_number() OVER (PARTITION BY company, text ORDER BY doc_id) AS n FROM c) WHERE n = 1")
def exact_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text of a company."""
    return first_per(chunks(spark, sf_dir), ["company", "text"], ["doc_id"]).select("doc_id", "company", "year")


@query()
def near_duplicates_removed_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy near-duplicate removal within company and year, on the whole texts of chunks."""
    rows = chunks(spark, sf_dir).select("company", "year", "doc_id", "text", F.format_string("%020d", "doc_id").alias("at"))
    return near_duplicates_removed(rows, ["company", "year"], "text", "at").select("company", "year", "doc_id", "text")


@query(r"SELECT page_id, url, regexp_matches(url, '(?i)(teams?|students?|benefits|culture|life|locations?|how-we|diversity|belonging|perks|values|mission|intern|grad|veterans|disability|accessibility|care-for|hiring|about)') AND NOT regexp_matches(url, '(?i)(/jobs/results|/jobs/\d|/job/\d|/positions?/|joblisting|search\?|/api/|\.pdf$|\.jpg$|\.png$|\.css$|\.js$|mailto:|javascript:)') AS content, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_replace(url, '[?#].*$', '') AS bare FROM pages")
def content_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", text.is_content_url(u).alias("content"), text.host_of(u).alias("host"), text.bare_url(u).alias("bare"))


@query("""
    WITH c AS (SELECT (2005 + doc_id % 20)::INT AS year, doc_id, source, text FROM documents WHERE lang = 'en')
    SELECT year, NULL AS doc_id, '## ' || year || ' (' || count(*) || ' chunks)' AS line FROM c GROUP BY year
    UNION ALL SELECT year, doc_id, '- ' || CASE WHEN length(source) > 0 THEN '**' || source || '** — ' ELSE '' END || coalesce(text, '') FROM c
""")
def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a review of the English chunks by year; titles have no doc_id."""
    rows = chunks(spark, sf_dir).where("lang = 'en'").withColumn("heading", F.col("company"))
    return review_lines(rows, ["doc_id"]).select("year", "place.doc_id", "line")
