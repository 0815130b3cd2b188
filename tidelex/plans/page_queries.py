"""Pages and captures: chunks, links, selection in time. Events stand for captures, users for URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.catalog import query
from tidelex.functions.html import chunk_pages, coverage, link_pages
from tidelex.operators import captures
from tidelex.operators.dedup import first_per, merged_captures, unseen
from tidelex.operators.joins import joined_in_blocks
from tidelex.plans.bindings import table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.withColumn("timestamp", F.concat((2005 + F.col("page_id") % 20).cast("string"), F.lit("0101000000")))


@query()
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_pages(_pages(spark, sf_dir)).select("page_id", "position", "chunk_id", "heading", "year", "word_count", "text")


@query()
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(chunk_pages(_pages(spark, sf_dir)))


@query(r"""
    WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, regexp_extract_all(html, '<a href="(/[^"?#]*)"', 1) AS hrefs FROM pages),
    l AS (SELECT page_id, site || unnest(hrefs) AS url, generate_subscripts(hrefs, 1) AS i FROM h),
    f AS (SELECT page_id, url, min(i) AS i FROM l WHERE regexp_matches(url, '/[a-z]+$') GROUP BY page_id, url)
    SELECT page_id, url, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS position FROM f QUALIFY position < 10
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links to paths of plain letters up to the reference's cap of ten, in document order."""
    return link_pages(_pages(spark, sf_dir), ["example.com", "example.org", "example.net"], content="(?-i:/[a-z]+$)")


@query(r"""
    WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, regexp_extract_all(html, '<a href="(/[^"?#]*)"', 1) AS hrefs FROM pages),
    l AS (SELECT page_id, site || unnest(hrefs) AS url, generate_subscripts(hrefs, 1) AS i FROM h),
    f AS (
        SELECT page_id, url, min(i) AS i FROM l
        WHERE regexp_matches(url, '(?i)(teams?|students?|benefits|culture|life|locations?|how-we|diversity|belonging|perks|values|mission|intern|grad|veterans|disability|accessibility|care-for|hiring|about)')
          AND NOT regexp_matches(url, '(?i)(/jobs/results|/jobs/\d|/job/\d|/positions?/|joblisting|search\?|/api/|\.pdf$|\.jpg$|\.png$|\.css$|\.js$|mailto:|javascript:)') GROUP BY page_id, url
    )
    SELECT page_id, url, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS position FROM f QUALIFY position < 10
""")
def page_content_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that the shipped content pattern and cap keep; the driver's pages hold none."""
    return link_pages(_pages(spark, sf_dir), ["example.com", "example.org", "example.net"])


def capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("urlkey"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"), F.concat(F.lit("http://u"), F.col("user_id").cast("string")).alias("original"),
        F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("digest"), F.col("event_id"), F.year("ts").alias("year"), "event_type",
    )


_CAPTURES = "WITH e AS (SELECT 'u' || user_id AS urlkey, strftime(ts, '%Y%m%d%H%M%S') AS timestamp, 'http://u' || user_id AS original, event_type || '-' || (props->>'$.k') AS digest, event_id, year(ts)::INT AS year, event_type FROM events)"


@query(_CAPTURES + " SELECT urlkey, substr(timestamp, 1, 6) AS month, min(timestamp) AS timestamp FROM e GROUP BY ALL")
def capture_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first capture of each URL and month."""
    return captures.one_per_month(capture_rows(spark, sf_dir)).select("urlkey", F.substring("timestamp", 1, 6).alias("month"), "timestamp")


@query(_CAPTURES + " SELECT digest, timestamp, original FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY timestamp, original) AS n FROM e) WHERE n = 1")
def first_per_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.first_per_digest(capture_rows(spark, sf_dir)).select("digest", "timestamp", "original")


@query(_CAPTURES + " SELECT digest, array_to_string(list(timestamp ORDER BY timestamp), ',') AS timestamps FROM e GROUP BY digest")
def digest_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.digest_timeline(capture_rows(spark, sf_dir)).select("digest", F.array_join("timestamps", ",").alias("timestamps"))


def _picks(rows: str, by: str) -> str:
    """SQL: the greedy choice of four of each year, one month after the other."""
    taken = [f"p{k} AS (SELECT {by}, year, min_by(i, abs(month - {m}) * 1000000 + i) AS i FROM nn WHERE n > 4{''.join(f' AND ({by}, year, i) NOT IN (SELECT ({by}, year, i) FROM p{j})' for j in range(k))} GROUP BY {by}, year)" for k, m in enumerate((2, 4, 8, 10))]
    numbered = f"nn AS (SELECT *, row_number() OVER (PARTITION BY {by}, year ORDER BY timestamp, event_id) AS i, count(*) OVER (PARTITION BY {by}, year) AS n FROM {rows})"
    return ", ".join([numbered, *taken]) + f", pp AS (SELECT * FROM nn WHERE n <= 4 OR ({by}, year, i) IN ({' UNION ALL '.join(f'SELECT ({by}, year, i) FROM p{k}' for k in range(4))}))"


# Captures whose months are moved by the event's id, so that they spread over some years.
_MOVED = _CAPTURES + ", mv AS (SELECT event_id, urlkey, original, digest, ts, strftime(ts::DATE + to_months((event_id % 30)::INT), '%Y%m%d') || '000000' AS timestamp FROM e JOIN (SELECT event_id, ts FROM events) USING (event_id)), mm AS (SELECT *, substr(timestamp, 1, 4)::INT AS year, substr(timestamp, 5, 2)::INT AS month FROM mv)"


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capture_rows(spark, sf_dir)
    return rows.withColumn("timestamp", F.date_format(F.add_months(F.to_timestamp("timestamp", "yyyyMMddHHmmss"), (F.col("event_id") % 30).cast("int")), "yyyyMMddHHmmss")).drop("year")


@query(f"{_MOVED}, {_picks('mm', 'urlkey')} SELECT urlkey, year, timestamp, event_id FROM pp")
def captures_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four captures of each URL and year, near evenly spaced months."""
    return captures.select_per_year(_moved(spark, sf_dir), ["urlkey"], ["event_id"]).select("urlkey", "year", "timestamp", "event_id")


@query(f"{_MOVED}, uu AS (SELECT *, event_id % 7 AS site FROM mm QUALIFY row_number() OVER (PARTITION BY urlkey, digest ORDER BY timestamp, event_id) = 1), {_picks('uu', 'site')} SELECT site, year, timestamp, event_id FROM pp")
def selected_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first capture of each page's digest, and of these four a site and year."""
    unique = first_per(_moved(spark, sf_dir), ["urlkey", "digest"], ["timestamp", "event_id"]).withColumn("site", F.col("event_id") % 7)
    return captures.select_per_year(unique, ["site"], ["event_id"]).select("site", "year", "timestamp", "event_id")


@query(_CAPTURES + " SELECT event_type, count(*) FILTER (year = 2023) AS y2023, count(*) FILTER (year = 2024) AS y2024 FROM e GROUP BY event_type")
def capture_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.year_pivot(capture_rows(spark, sf_dir), "event_type", [2023, 2024])


@query("WITH k AS (SELECT DISTINCT (year(o_orderdate) + CASE WHEN year(o_orderdate) > 1998 THEN 2 ELSE 0 END)::INT AS year FROM orders) SELECT y::INT AS year FROM (SELECT unnest(generate_series(1990, (SELECT max(year) FROM k))) AS y) WHERE y NOT IN (SELECT year FROM k)")
def gap_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years without orders from 1990 on, with a gap made after 1998."""
    y = F.year("o_orderdate")
    return captures.gap_years(table(spark, sf_dir, "orders").select((y + F.when(y > 1998, 2).otherwise(0)).alias("year")), "year", 1990)


@query(_CAPTURES + """
    , t AS (SELECT DISTINCT original, substr(timestamp, 1, 8) || '120000' AS target FROM e)
    SELECT t.original, t.target, arg_min(e.timestamp, row(abs(e.timestamp::BIGINT - t.target::BIGINT), e.timestamp)) AS timestamp FROM t JOIN e ON e.original = t.original GROUP BY t.original, t.target
""")
def nearest_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capture_rows(spark, sf_dir)
    targets = rows.select("original", F.concat(F.substring("timestamp", 1, 8), F.lit("120000")).alias("target")).distinct()
    return captures.nearest_capture(targets, rows).select("original", "target", "nearest.timestamp")


@query(_CAPTURES + """
    , k AS (FROM e WHERE event_id % 3 = 0), f AS (FROM e WHERE event_id % 3 <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY timestamp, original) AS r FROM f WHERE (original, timestamp) NOT IN (SELECT (original, timestamp) FROM k) AND digest NOT IN (SELECT digest FROM k))
    SELECT event_id FROM k UNION ALL SELECT event_id FROM n WHERE r = 1
""")
def merged_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known captures and the new ones by (url, time) and digest."""
    rows = capture_rows(spark, sf_dir)
    return merged_captures(rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0")).select("event_id")


@query("""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id FROM n WHERE i % greatest(n // 5, 1) = 0 AND i // greatest(n // 5, 1) < 5
""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.stride_sample(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


# Orders as filings of 2009 and later: a company's recent ones in one block, those it made before in another.
_FILED = """
    WITH f AS (SELECT c_custkey % 50 AS cik, CASE WHEN o_orderkey % 3 = 0 THEN '10-K' ELSE '8-K' END AS form, lpad(o_orderkey::VARCHAR, 10, '0') || '-09-' || o_orderkey % 7 AS acc, strftime(o_orderdate + INTERVAL 14 YEAR, '%Y-%m-%d') AS d FROM orders JOIN customer ON o_custkey = c_custkey)
"""
_BY_YEAR = """
    , y AS (SELECT cik, substr(d, 1, 4)::INT AS year, arg_max(d, row(d, acc)) AS "filingDate", arg_max(acc, row(d, acc)) AS "accessionNumber" FROM f WHERE form = '10-K' {since} GROUP BY 1, 2)
"""


def _latest(spark: SparkSession, sf_dir: str, first_year: int | None) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, date = F.col("o_orderkey"), F.add_months("o_orderdate", 168).cast("string")
    fields = {"form": F.when(key % 3 == 0, "10-K").otherwise("8-K"), "accessionNumber": F.concat(F.lpad(key.cast("string"), 10, "0"), F.lit("-09-"), (key % 7).cast("string")), "filingDate": date, "primaryDocument": F.lit("doc.htm")}
    by = [(F.col("c_custkey") % 50).alias("cik"), (F.year("o_orderdate") >= 1999).alias("recent")]
    blocks = o.groupBy(*by).agg(*[F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", x.alias("x")))), lambda s: s["x"]).alias(n) for n, x in fields.items()])
    return captures.latest_filing_per_year(blocks, ["cik"], first_year)


@query(_FILED + _BY_YEAR.format(since="") + "FROM y")
def latest_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent and historical blocks of filings, decoded; the last annual report of each year."""
    return _latest(spark, sf_dir, None).select("cik", "year", "filingDate", "accessionNumber")


@query(_FILED + _BY_YEAR.format(since="AND d >= '2010'") + """
    SELECT lpad(cik::VARCHAR, 10, '0') AS cik, year, 'https://filings.example/data/' || cik || '/' || replace("accessionNumber", '-', '') || '/doc.htm' AS source_url
    FROM y QUALIFY row_number() OVER (PARTITION BY cik ORDER BY year DESC) <= 3
""")
def filing_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each company's three latest annual reports."""
    return captures.last_filings(_latest(spark, sf_dir, captures.FIRST_FILING_YEAR), "cik", 3, "https://filings.example/data").select("cik", "year", "source_url")


@query("""
    WITH l AS (SELECT 'http://u' || user_id AS url, count(*) AS n_parents FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT url, CASE WHEN url IN (SELECT 'http://u' || user_id FROM events WHERE event_type = 'purchase' AND value > 30) THEN 'already_fetched'
                     WHEN url IN (SELECT 'http://u' || user_id FROM events WHERE event_type = 'view' AND value > 30) THEN 'candidate' ELSE 'no_cdx' END AS status, n_parents FROM l
""")
def discovered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harvested links with their status against what was fetched and what is archived."""
    e = table(spark, sf_dir, "events").withColumn("url", F.concat(F.lit("http://u"), F.col("user_id").cast("string")))
    return captures.discovered_links(e.where("event_type = 'click'"), e.where("event_type = 'purchase' AND value > 30"), e.where("event_type = 'view' AND value > 30"))


@query(_CAPTURES + """
    , d AS (SELECT original, event_type, count(*) AS n_captures, list(DISTINCT year ORDER BY year) AS years FROM e GROUP BY ALL)
    SELECT event_type, original, n_captures, years FROM d WHERE original NOT IN (SELECT original FROM e GROUP BY original HAVING arg_min(event_type, (timestamp, event_id)) = 'purchase')
""")
def probed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures and years of each probed page, without those that are known, here pages first captured by a purchase."""
    c = capture_rows(spark, sf_dir)
    known = c.groupBy("original").agg(F.min_by("event_type", F.struct("timestamp", "event_id")).alias("first")).where("first = 'purchase'")
    found = c.groupBy("event_type", "original").agg(F.count(F.lit(1)).alias("n_captures"), F.array_sort(F.collect_set("year")).alias("years"))
    return unseen(found, known, ["original"]).select("event_type", "original", "n_captures", "years")


@query(_CAPTURES + """
    , p AS (SELECT unnest(['u1*', 'u12', 'u2?', 'u%']) AS pattern)
    SELECT pattern, count(*) AS n_captures, count(DISTINCT urlkey) AS n_urls, min(timestamp) AS first, max(timestamp) AS last
    FROM p JOIN e ON CASE WHEN pattern LIKE '%*' THEN starts_with(urlkey, rtrim(pattern, '*')) ELSE urlkey = pattern END GROUP BY pattern
""")
def captures_per_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pattern of an index query finds: a star at the end asks for a prefix, any other pattern for one page."""
    patterns = spark.createDataFrame([("u1*",), ("u12",), ("u2?",), ("u%",)], "pattern string")
    at = F.when(F.endswith("pattern", F.lit("*")), F.startswith("urlkey", F.rtrim("pattern", F.lit("*")))).otherwise(F.col("urlkey") == F.col("pattern"))
    found = joined_in_blocks(capture_rows(spark, sf_dir), patterns, at)
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_captures"), F.countDistinct("urlkey").alias("n_urls"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
