"""Sections and chunks of annual filings, synthesised from documents, and terms of lexicons over the years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.catalog import query
from tidelex.functions.html import chunk_filings, filing_texts
from tidelex.functions.text import BUSINESS, HUMAN_CAPITAL, RISK_FACTORS, filing_sections
from tidelex.operators.joins import matching_patterns
from tidelex.plans.bindings import table

#: What stands around a document's text in the synthesised filings, by doc_id % 7.
FRAMES = [
    ("ITEM 1. BUSINESS ", " Human Capital Management we employ many. Government Regulation x ITEM 1A. RISK FACTORS risks abound. ITEM 1B. none"),
    ("Item 1. Business prose. Culture and Workforce ", " Available Information. Human Capital more Item 1A"),
    ("ITEM 1A RISK  FACTORS ", " ITEM 2. Properties"),
    ("ITEM 1 BUSINESS ", " ITEM 1A. ITEM 2."),
    ("Human Capital ", " and no end"),
    ("Human Capital Resources\nHuman Capital ", " Intellectual Property"),
    ("ITEM\u00a01A.\u2003RISK\u00a0\u00a0FACTORS ", " ITEM\u00a01B.\u00a0none"),
]
_FILINGS = "WITH f AS (SELECT doc_id AS filing_id, (2005 + doc_id % 20)::INT AS year, regexp_replace(CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN '{a}' || text || '{b}'" for k, (a, b) in enumerate(FRAMES)) + r" END, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g') AS t FROM documents)"


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = lambda k: F.element_at(F.array(*[F.lit(f[k]) for f in FRAMES]), (F.col("doc_id") % 7 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("filing_id"), (2005 + F.col("doc_id") % 20).cast("int").alias("year"), F.explode(filing_sections(F.concat(around(0), "text", around(1)))).alias("s")).select("filing_id", "year", "s.section", "s.text")


def _found(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(t, '{pattern}') THEN substr(trim(regexp_extract(t, '{pattern}', 1)), 1, 12000) END"


@query(_FILINGS + f""",
    s AS (SELECT *, coalesce({", ".join(map(_found, HUMAN_CAPITAL))}) AS people, {_found(RISK_FACTORS)} AS risks, {_found(BUSINESS)} AS business FROM f),
    l AS (SELECT filing_id, year, 'Human Capital' AS section, people AS text FROM s UNION ALL SELECT filing_id, year, 'Risk Factors', risks FROM s
          UNION ALL SELECT filing_id, year, 'Business', business FROM s WHERE people IS NULL AND risks IS NULL)
    FROM l WHERE text IS NOT NULL
""")  # fmt: skip
def filing_section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human Capital and Risk Factors of every filing, Business where it has neither."""
    return _filings(spark, sf_dir)


def _filing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as annual filings: no-break spaces, a table that names the next item, and a script."""
    head = "<html><head><style>p {}</style></head><body><p>ITEM&nbsp;1A.&nbsp;RISK&#160;FACTORS</p>"
    tail = "<table><tr><td>ITEM 1B.<table><tr><td>within</td></tr></table></td></tr></table><script>ITEM 1B.</script><p>ITEM&nbsp;1B.&nbsp;None"
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("filing_id"), (2005 + F.col("page_id") % 20).cast("int").alias("year"), F.concat(F.lit(head), "html", F.lit(tail)).alias("html"))


@query()
def filing_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings from HTML to text to whole sections to chunks."""
    texts = filing_texts(_filing_pages(spark, sf_dir))
    sections = texts.select("filing_id", "year", F.explode(filing_sections(F.col("text"), cap=None)).alias("s")).select("filing_id", "year", "s.section", "s.text")
    return chunk_filings(sections)


@query()
def filing_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole sentences, 40 to about 250 words, of every section."""
    return chunk_filings(_filings(spark, sf_dir))


#: Lexicon, term, pattern, and a phrase that the term's pattern finds.
LEXICON = [
    ("civilizational", "the west", r"(?i)\bthe west(?:ern)?(?:'s|\s+(?:most|important|values|institutions))?\b", "the west most"),
    ("civilizational", "western institutions", r"(?i)\bwestern\s+(?:tech\s+)?institutions\b", "western tech institutions"),
    ("civilizational", "civilization", r"(?i)\bcivilization(?:al)?\b", "civilizational"),
    ("civilizational", "warfighter", r"(?i)\bwarfighters?\b", "warfighters"),
    ("work_hard_play_hard", "work hard play hard", r"(?i)\bwork hard(?:,)? play hard\b", "work hard, play hard"),
    ("work_hard_play_hard", "crush it", r"(?i)\bcrush(?:ing)? it\b", "crushing it"),
    ("work_hard_play_hard", "rockstar", r"(?i)\brock\s*stars?\b", "rock stars"),
    ("work_hard_play_hard", "hustle", r"(?i)\bhustl(?:e|ing|er)\b", "hustling"),
    ("work_hard_play_hard", "a-player", r"(?i)\bA[\s-]?players?\b", "A-players"),
    ("hardcore", "hardcore", r"(?i)\b(?:extremely\s+)?hard[\s-]?core\b", "extremely hardcore"),
    ("hardcore", "high performance", r"(?i)\bhigh[\s-]performance\b", "high performance"),
    ("hardcore", "intensity", r"(?i)\bintensit(?:y|ies)\b", "intensity"),
    ("hardcore", "raise the bar", r"(?i)\braise(?:s|d)? the bar\b", "raised the bar"),
    ("hardcore", "exceptional talent", r"(?i)\bexceptional talent\b", "exceptional talent"),
]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LEXICON = f"""
    WITH d AS (SELECT doc_id, source AS company, (2005 + doc_id // 14 % 20)::INT AS year, text || ' ' || CASE doc_id % 14 {" ".join(f"WHEN {k} THEN {_sql_text(x[3])}" for k, x in enumerate(LEXICON))} END AS t FROM documents),
    p(lexicon, term, pattern) AS (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)}, {_sql_text(c)})" for a, b, c, _ in LEXICON)}),
    h AS (SELECT doc_id, company, year, lexicon, term FROM d JOIN p ON regexp_matches(t, pattern))
"""


def _lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([x[:3] for x in LEXICON], "lexicon string, term string, pattern string")
    phrase = F.element_at(F.array(*[F.lit(x[3]) for x in LEXICON]), (F.col("doc_id") % 14 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("company"), (2005 + F.floor(F.col("doc_id") / 14) % 20).cast("int").alias("year"), F.concat("text", F.lit(" "), phrase).alias("t"))
    return matching_patterns(docs, "t", patterns).drop("t")


@query(_LEXICON + "SELECT lexicon, term, min(year) AS first_year, max(year) AS last_year, count(*) AS n_hits, count(DISTINCT company) AS n_companies FROM h GROUP BY lexicon, term")
def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of all lexicons: first and last year, hits and companies."""
    return _lexicon_hits(spark, sf_dir).groupBy("lexicon", "term").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n_hits"), F.countDistinct("company").alias("n_companies"))


@query(_LEXICON + "SELECT company, lexicon, array_to_string(list(DISTINCT term ORDER BY term), ', ') AS terms, count(*) AS n_hits FROM h WHERE company <> 'src1' GROUP BY company, lexicon")
def merged_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's terms of every lexicon, but for companies that the story leaves out."""
    kept = _lexicon_hits(spark, sf_dir).where(~F.col("company").isin("src1"))
    return kept.groupBy("company", "lexicon").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"), F.count(F.lit(1)).alias("n_hits"))
