"""Readers and writers of the library's file formats; every read states its schema."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.storage import kept

CHUNK = "chunk_id string, text string, heading string, source_url string, timestamp string, year int, word_count int, position int, extraction_source string"
AXIS = "name string, single_pole boolean, sentences array<struct<pole:string,label:string,position:int,sentence:string>>"
MANUAL = "file string, url string, capture_date string, source string"
YEARS = "array<struct<year:int,zscore:double>>"
PATTERNS = "array<struct<url:string,match_type:string,era_hint:string>>"
PROFILE = (
    "company string, display_name string, comment string, hosts array<string>, spa_content_paths array<string>, validation struct<expected_altruism_peak:int,tolerance:int,notes:array<string>>, "
    f"patterns {PATTERNS}, spa_json_probes {PATTERNS}, alt_domains {PATTERNS}"
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; blank lines give no row."""
    return spark.read.schema(schema).json(path)


def read_chunks(spark: SparkSession, folder: str, schema: str = CHUNK) -> DataFrame:
    """All yearly files of a folder with ``file``, whose order and then ``position`` is the order of the chunks."""
    return read_jsonl(spark, f"{folder}/*.jsonl", schema).withColumn("file", F.col("_metadata.file_name"))


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """JSON lines in one subfolder per year; rows reach their year's writers by one shuffle."""
    chunks.repartition("year").write.mode("overwrite").partitionBy("year").json(folder)


def read_labels(spark: SparkSession, path: str, columns: str, label: str) -> DataFrame:
    """A CSV of hand labels; labels are trimmed, rows without one are left out."""
    rows = spark.read.schema(columns).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn(label, F.trim(label)).where(F.coalesce(F.length(label), F.lit(0)) > 0)


def read_profiles(spark: SparkSession, path: str | list[str], schema: str = PROFILE) -> DataFrame:
    """Company profiles, one JSON object a file: the display name defaults to the title-cased id, the tolerance to 2.

    Lists of probes and other domains are empty where they are missing.
    """
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    named = rows.withColumn("display_name", F.coalesce("display_name", F.initcap("company")))
    named = named.withColumns({c: F.coalesce(c, F.array().cast(PATTERNS)) for c in ("spa_json_probes", "alt_domains") if c in rows.columns})
    filled = F.col("validation").withField("tolerance", F.coalesce("validation.tolerance", F.lit(2)))
    return named.withColumn("validation", F.when(F.col("validation").isNotNull(), filled))


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, label of a JSON object that maps one to the other."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("chunk_id", "label"))


def read_axes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """axis, single_pole, pole ("a" or "b"), label, position, sentence of axis definitions, one YAML document a file.

    Pole b may be missing or empty; the axis then has a single pole. A file without name or pole a is an error.
    """

    @F.udf(AXIS)
    def parsed(text: str):
        import yaml

        raw = yaml.safe_load(text)
        poles = [(k, raw[f"pole_{k}"]) for k in ("a", "b") if k == "a" or raw.get("pole_b")]
        rows = [(k, p["label"], i, s) for k, p in poles for i, s in enumerate(p["sentences"])]
        return raw["name"], not any(r[0] == "b" for r in rows), rows

    files = spark.read.text(path, wholetext=True).select(parsed("value").alias("axis"))
    return files.select(F.col("axis.name").alias("axis"), "axis.single_pole", F.inline("axis.sentences"))


def manual_captures(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """original, timestamp, digest, html_file, source, file of saved pages, as captures to merge with known ones.

    ``listed`` has a row of ``MANUAL`` per capture; one whose file is missing gives no row. A date of eight digits
    means noon. Files are hashed where they are read: no page is shuffled.
    """
    pages = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.left(F.sha2("content", 256), F.lit(24)).alias("digest"))
    stamp = F.when(F.length("capture_date") == 8, F.concat("capture_date", F.lit("120000"))).otherwise(F.col("capture_date"))
    rows = listed.withColumn("timestamp", stamp).join(pages, "file")
    return rows.select(F.col("url").alias("original"), "timestamp", "digest", F.concat_ws("_", "timestamp", F.concat("digest", F.lit(".html"))).alias("html_file"), F.coalesce("source", F.lit("manual")).alias("source"), "file")


BLOCK = "form array<string>, accessionNumber array<string>, filingDate array<string>, primaryDocument array<string>"


def read_filing_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """cik and parallel arrays of a folder of saved filing indexes: the recent block of each company's file, and the historical files that it names.

    A company's file is ``CIK`` and ten digits; a historical file that no company's file names gives no row.
    """
    fields = BLOCK.replace(" array", ":array").replace(", ", ",")
    company = f"cik string, filings struct<recent:struct<{fields}>,files:array<struct<name:string>>>"
    read = lambda schema, names: spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", names).json(folder)
    files = read(company, "CIK??????????.json")
    named = files.select("cik", F.explode("filings.files.name").alias("name")).distinct()
    old = read(BLOCK, "CIK*-*.json").withColumn("name", F.col("_metadata.file_name"))
    recent = files.where("filings.recent is not null").select("cik", "filings.recent.*")
    return recent.unionByName(named.join(old, "name").drop("name"))


ANSWER_FIELDS = ["urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length"]


def read_index_answers(spark: SparkSession, folder: str, url: str | None = None, match_type: str | None = None, from_ts: str = "2005", to_ts: str | None = None, status: str | None = "200", monthly: bool = True) -> DataFrame:
    """Captures of saved index answers, as an index query returns them.

    An answer is a JSON array of rows of which the first names the fields, in a folder ``match_type=.../site=.../since=.../until=...``
    (years) of the question that it answers; folders that the arguments rule out are not opened. A time stamp counts as
    in range by the digits that the bounds have. ``url`` is compared with the address, as a whole or, for the match types
    prefix, host and domain, by what it begins with, its host, or its host and those below it. ``monthly`` keeps the first capture of each URL and month. An empty
    answer gives no row, a missing length is 0.
    """
    files = spark.read.option("wholetext", True).schema("value string, match_type string, site string, since int, until int").text(folder)
    site = lambda u: F.regexp_replace(F.regexp_replace(F.lower(u), r"^[a-z]+://", ""), r"^www\.", "")
    files = files.where(F.col("until") >= int(from_ts[:4]))
    if to_ts:
        files = files.where(F.col("since") <= int(to_ts[:4]))
    if match_type:
        files = files.where(F.col("match_type") == match_type)
    answers = files.select("match_type", F.from_json("value", "array<array<string>>").alias("rows")).where(F.size("rows") > 1)
    rows = answers.select("match_type", F.explode(F.slice("rows", 2, F.size("rows") - 1)).alias("r"), F.element_at("rows", 1).alias("h")).withColumn("record", F.map_from_arrays("h", "r"))
    found = rows.select(*[F.col("record")[c].alias(c) for c in ANSWER_FIELDS], "match_type").withColumn("length", F.coalesce(F.expr("try_cast(length as int)"), F.lit(0)))
    found = found.where(F.left("timestamp", F.lit(len(from_ts))) >= from_ts)
    if to_ts:
        found = found.where(F.left("timestamp", F.lit(len(to_ts))) <= to_ts)
    if status:
        found = found.where(F.col("statuscode") == status)
    if url:
        here, wanted = site(F.col("original")), site(F.lit(url))
        host = lambda u: F.regexp_extract(u, r"^[^/?#:]*", 0)
        below = (host(here) == host(wanted)) | F.endswith(host(here), F.concat(F.lit("."), host(wanted)))
        rule = {"exact": F.rtrim(here, F.lit("/")) == F.rtrim(wanted, F.lit("/")), "prefix": F.startswith(here, wanted), "host": host(here) == host(wanted), "domain": below}
        found = found.where(rule[match_type or "exact"])
    found = found.drop("match_type").distinct()
    if not monthly:
        return found
    first = Window.partitionBy("urlkey", F.left("timestamp", F.lit(6))).orderBy("timestamp", "digest", "original")
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def publish(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the entries of ``rows`` (one per value of ``by``) in a published table and leave all others.

    Entries are folders that the commit of the write renames into place, so a job that fails leaves the old ones,
    and writers of different entries do not meet. The rows are computed before, as they may be read from the table itself.
    """
    ready = kept(rows, "published")
    ready.repartition(*by).sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


MANIFEST = "company string, display_name string, axes array<string>"


def published(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A published table; no rows where nothing has been published. Each read sees what is there now."""
    return spark.read.schema(schema).option("readAs", uuid.uuid4().hex).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def publish_manifest(entries: DataFrame, path: str, replace: bool = False) -> None:
    """Put (company, display_name, axes) into the manifest: the name anew, the axes added to those there, or, with ``replace``, instead of them.

    ``control`` is an overlay of other axes and never listed. Axes are sorted; of entries that repeat a company the axes are joined.
    """
    new = entries.groupBy("company").agg(F.min("display_name").alias("display_name"), F.flatten(F.collect_list("axes")).alias("axes"))
    old = published(entries.sparkSession, path).select("company", F.col("axes").alias("old"))
    both = new.join(old, "company", "left").withColumn("axes", F.col("axes") if replace else F.concat("axes", F.coalesce("old", F.array().cast("array<string>"))))
    publish(both.select("company", "display_name", F.array_sort(F.array_distinct(F.filter("axes", lambda a: a != "control"))).alias("axes")), path, ["company"])


def read_series(spark: SparkSession, path: str | list[str], years: str = YEARS) -> DataFrame:
    """company, axis and a row per year of published series; older files nest years by level, sentences before chunks."""
    levels = f"struct<sentence:struct<years:{years}>,chunk:struct<years:{years}>>"
    rows = spark.read.schema(f"company string, axis string, years {years}, levels {levels}").option("multiLine", True).json(path)
    return rows.select("company", "axis", F.inline(F.coalesce("years", "levels.sentence.years", "levels.chunk.years")))


def write_documents(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Each row as one indented JSON document in the subfolder of its ``by``; letters beyond ASCII stay as they are."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in by]), {"pretty": "true"})
    rows.select(*by, body.alias("value")).write.mode("overwrite").partitionBy(*by).text(folder)


def write_sheet(sample: DataFrame, path: str, label: str = "label") -> None:
    """A sample as a CSV to label by hand: its columns and an empty one, in one file as people edit it."""
    sheet = sample.withColumn(label, F.lit(None).cast("string"))
    sheet.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def review_lines(rows: DataFrame, order: list[str], heading: str = "heading", text: str = "text") -> DataFrame:
    """year, place, line of a review in Markdown: a title with the count for each year, then an item per row.

    ``place`` is null for titles, and else a struct of ``order``; sorted by both, nulls first, the lines make the review.
    """
    title = F.concat(F.lit("## "), F.col("year").cast("string"), F.lit(" ("), F.count(F.lit(1)).cast("string"), F.lit(" chunks)"))
    place = F.struct(*order)
    head = F.when(F.length(heading) > 0, F.concat(F.lit("**"), F.col(heading), F.lit("** — "))).otherwise("")
    items = rows.select("year", place.alias("place"), F.concat(F.lit("- "), head, F.coalesce(text, F.lit(""))).alias("line"))
    titles = rows.groupBy("year").agg(title.alias("line"))
    return titles.select("year", F.lit(None).cast(items.schema["place"].dataType).alias("place"), "line").unionByName(items)


def write_review(lines: DataFrame, path: str) -> None:
    """The lines of a review in their order over the files' order."""
    ordered = lines.orderBy("year", F.col("place").asc_nulls_first())
    ordered.select("line").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def append_new(rows: DataFrame, path: str, on: list[str]) -> None:
    """Append to a Parquet cache the rows whose key it lacks; of a key that repeats in ``rows`` the least row by the other columns is written."""
    spark = rows.sparkSession
    known = spark.read.schema(rows.schema).option("ignoreMissingFiles", True).parquet(path) if path_exists(spark, path) else None
    rest = [c for c in rows.columns if c not in on]
    new = rows.groupBy(*on).agg(F.min(F.struct(*rest)).alias("__least")).select(*on, "__least.*").select(*rows.columns) if rest else rows.distinct()
    (new if known is None else new.join(known.select(*on), on, "left_anti").select(*rows.columns)).write.mode("append").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def decoded(header: Column, values: Column) -> Column:
    """A map of a header row's names to a row's values, as an archive index answers."""
    return F.map_from_arrays(header, values)


def yearly(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group in ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))).where("__n = 1").drop("__n")
