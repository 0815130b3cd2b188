"""Archived captures: decoding index rows, one per month or digest, selection within the year, merging, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.operators.dedup import first_per
from tidelex.operators.joins import nearest


def header_rows(table: DataFrame, rows: str = "rows") -> DataFrame:
    """Records of an index answer whose first row names the fields: map<string,string> per record."""
    body = table.select(F.explode(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).alias("r"), F.element_at(rows, 1).alias("h"))
    return body.select(F.map_from_arrays("h", "r").alias("record"))


def one_per_month(captures: DataFrame, key: str = "urlkey", ts: str = "timestamp") -> DataFrame:
    """The first capture of each URL in each calendar month."""
    return first_per(captures, [key, F.substring(ts, 1, 6)], [ts])


def first_per_digest(captures: DataFrame, digest: str = "digest", ts: str = "timestamp", tie: str = "original") -> DataFrame:
    return first_per(captures, [digest], [ts, tie])


def digest_timeline(captures: DataFrame, digest: str = "digest", ts: str = "timestamp") -> DataFrame:
    """digest, timestamps (sorted): when a page was unchanged."""
    return captures.groupBy(digest).agg(F.array_sort(F.collect_list(ts)).alias("timestamps"))


def select_per_year(captures: DataFrame, by: list[str], tie: list[str], per_year: int = 4, ts: str = "timestamp") -> DataFrame:
    """Up to ``per_year`` captures of each year: for evenly spaced months, each time the closest capture not yet taken, ties by ``ts`` and ``tie``.

    Months are rounded half to even, so four a year aim at 2, 4, 8 and 10. Of a month no more than its first
    ``per_year`` captures can be taken, so a year is a fold over an array of bounded size. ``ts`` and ``tie`` make a total order.
    """
    months = F.array(*[F.lit(round((i + 0.5) * 12 / per_year)) for i in range(per_year)])
    rows = captures.withColumns({"year": F.substring(ts, 1, 4).cast("int"), "__month": F.substring(ts, 5, 2).cast("int")})
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "year", "__month").orderBy(ts, *tie))).where(F.col("__n") <= per_year).drop("__n")
    order = [ts, *[c for c in tie if c != ts]]
    years = first.groupBy(*by, "year").agg(F.array_sort(F.collect_list(F.struct(*order, "__month", F.struct(*[c for c in rows.columns if c != "__month"]).alias("row")))).alias("all"))
    sized = years.withColumn("all", F.transform("all", lambda x, i: F.struct(i.alias("i"), x["__month"].alias("month"), x["row"].alias("row"))))

    def take(acc, month):
        nearest = F.array_min(F.transform(F.filter(F.col("all"), lambda x: ~F.array_contains(acc, x["i"])), lambda x: F.struct(F.abs(x["month"] - month).alias("away"), x["i"].alias("i"))))["i"]
        return F.when(nearest.isNull(), acc).otherwise(F.concat(acc, F.array(nearest)))

    taken = sized.withColumn("taken", F.aggregate(months, F.array().cast("array<int>"), take))
    kept = F.filter("all", lambda x: F.array_contains("taken", x["i"]))
    return taken.select(F.explode(kept).alias("x")).select("x.row.*").select(*captures.columns, *(["year"] if "year" not in captures.columns else []))


def nearest_capture(targets: DataFrame, captures: DataFrame, url: str = "original") -> DataFrame:
    """Per (url, target timestamp) the capture whose digits differ least, as integers; ties to the earlier."""
    me, at = F.col("target").cast("long"), F.col("timestamp").cast("long")
    return nearest(targets, captures, [url], me, at, ["timestamp", "digest"], ["timestamp", "digest"])


def year_pivot(captures: DataFrame, pattern: str, years: list[int], year: str = "year") -> DataFrame:
    return captures.groupBy(pattern).agg(*[F.count_if(F.col(year) == y).alias(f"y{y}") for y in years])


def gap_years(captures: DataFrame, year: str = "year", first: int = 2005) -> DataFrame:
    """Years from ``first`` to the last with captures that have none."""
    known = captures.select(year).distinct()
    span = captures.agg(F.max(year).alias("last")).where(F.col("last") >= first)
    return span.select(F.explode(F.sequence(F.lit(first), F.col("last").cast("int"))).alias(year)).join(known, year, "left_anti")


def stride_sample(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Every n//k-th row of each group in order, k at most."""
    w = Window.partitionBy(*by)
    numbered = rows.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.floor(F.col("__n") / k), F.lit(1))
    return numbered.where((F.col("__i") % step == 0) & (F.col("__i") / step < k)).drop("__i", "__n")


FIRST_FILING_YEAR = 2010


def filing_rows(blocks: DataFrame, by: list[str], first_year: int | None = FIRST_FILING_YEAR) -> DataFrame:
    """Blocks of parallel arrays (form, accessionNumber, filingDate, primaryDocument) as rows: annual reports from ``first_year`` on, or of all years."""
    zipped = blocks.select(*by, F.explode(F.arrays_zip("form", "accessionNumber", "filingDate", "primaryDocument")).alias("f")).where("f.form = '10-K'")
    rows = zipped.select(*by, F.substring("f.filingDate", 1, 4).cast("int").alias("year"), "f.filingDate", "f.accessionNumber", "f.primaryDocument")
    return rows if first_year is None else rows.where(F.col("year") >= first_year)


def latest_filing_per_year(filings: DataFrame, by: list[str], first_year: int | None = FIRST_FILING_YEAR) -> DataFrame:
    """The last annual report of each calendar year, from blocks of parallel arrays; ties to the larger accession number."""
    rows = filing_rows(filings, by, first_year)
    return rows.groupBy(*by, "year").agg(F.max_by(F.struct("filingDate", "accessionNumber", "primaryDocument"), F.struct("filingDate", "accessionNumber")).alias("f")).select(*by, "year", "f.*")


def last_filings(filings: DataFrame, cik: str, n: int, archives: str) -> DataFrame:
    """The ``n`` latest years of each company, with padded ``cik`` and the address of the document below ``archives``."""
    latest = filings.withColumn("__n", F.row_number().over(Window.partitionBy(cik).orderBy(F.desc("year")))).where(F.col("__n") <= n).drop("__n")
    url = F.concat_ws("/", F.lit(archives), F.col(cik).cast("long").cast("string"), F.replace("accessionNumber", F.lit("-"), F.lit("")), "primaryDocument")
    return latest.withColumns({"source_url": url, cik: F.lpad(F.col(cik).cast("string"), 10, "0")})


def discovered_links(links: DataFrame, fetched: DataFrame, captures: DataFrame) -> DataFrame:
    """url, status, n_parents: already_fetched, no_cdx (no capture known) or candidate."""
    urls = links.groupBy("url").agg(F.count(F.lit(1)).alias("n_parents"))
    done = fetched.select("url").distinct().withColumn("done", F.lit(True))
    known = captures.select("url").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("done"), "already_fetched").when(F.col("known"), "candidate").otherwise("no_cdx")
    return urls.join(done, "url", "left").join(known, "url", "left").select("url", status.alias("status"), "n_parents")
