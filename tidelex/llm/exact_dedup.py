"""Exact deduplication through a log-structured merge index of text digests. DataFrame functions only.

Memtables (slices of the input, aggregated in memory before the shuffle) flush sorted digest runs as Parquet
with a Bloom filter and min/max statistics per row group. Compaction merges the runs and keeps one identifier
per digest. Hits, the rows whose digest another row shares, are then verified byte by byte: their texts are
grouped under their digest, and a digest that stands for two texts is split by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import cut, scratch, text_or_empty, unused


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


class DigestIndex:
    """A merge index over (digest, id) in the shared folder.

    ``keep`` says which identifier compaction leaves per digest: "smallest" or "largest".
    """

    def __init__(self, spark, path: str | None = None, keep: str = "smallest", memtables: int = 4):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be smallest or largest, not {keep!r}")
        self.spark, self.keep, self.memtables = spark, keep, memtables
        self.path = path or scratch(spark, "digest-index")
        self.runs: list[str] = []
        self.flushed = 0

    def _best(self, column: str) -> Column:
        return (F.min if self.keep == "smallest" else F.max)(column)

    def _flush(self, rows: DataFrame, by: list[str]) -> None:
        run = f"{self.path}/run-{self.flushed:04d}"
        self.flushed += 1
        writer = rows.sortWithinPartitions("digest").write.mode("overwrite")
        # filters sized to what a run holds, not to the format's 1 MB for every file
        writer = writer.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        (writer.partitionBy(*by) if by else writer).parquet(run)
        self.runs.append(run)

    def insert(self, keyed: DataFrame) -> None:
        """Flush ``keyed`` (id, digest): one sorted run per memtable, each with one row per digest.

        The memtable is summed before the shuffle, so a digest with a third of all rows moves as one row a task.
        """
        memtable = F.pmod(F.xxhash64("id"), F.lit(self.memtables)).cast("int")
        rows = keyed.groupBy(memtable.alias("memtable"), "digest").agg(self._best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        self._flush(rows, ["memtable"])

    def compact(self) -> None:
        """Merge all runs into one; a digest keeps one identifier and the sum of its rows."""
        old, merged = list(self.runs), self.read().groupBy("digest").agg(self._best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        self._flush(merged, [])
        self.runs = [r for r in self.runs if r not in old]

    def read(self) -> DataFrame:
        frames = [self.spark.read.schema("digest binary, keep_id long, n long").parquet(r).select("digest", "keep_id", "n") for r in self.runs]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def find(self, digests: list[bytes]) -> DataFrame:
        """Entries of a few digests; the runs' filters and statistics skip the rest."""
        return self.read().where(F.col("digest").isin([bytearray(d) for d in digests]))


def _keyed(docs: DataFrame, digest) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(digest(text)).alias("digest"), text.alias("body"))


def exact_duplicates(docs: DataFrame, keep: str = "smallest", memtables: int = 4, digest=sha256_hex) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (hex), n_rows.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the smallest (or
    largest) doc_id stays. Rows that repeat both doc_id and text come back as one row with n_rows > 1 and each
    counts in group_size. A null doc_id never wins over one that is set; a group with null ids only keeps null.
    An empty table gives no rows. Texts of any length are hashed and compared whole. Other columns are not read, so
    their names do not matter.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, keep=keep, memtables=memtables)
    keyed = _keyed(docs, digest)
    index.insert(keyed.select("id", "digest"))
    index.compact()
    entries = index.read()
    rows = keyed.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n_rows"))
    found = rows.join(entries, "digest")

    # byte verification: only members of groups carry their text on
    hits = found.where("n > 1").select("id", "digest").withColumnsRenamed({"id": "hit_id", "digest": "hit_digest"})
    bodies = keyed.join(hits, (F.col("id").eqNullSafe(F.col("hit_id"))) & (F.col("digest") == F.col("hit_digest")))
    best = F.min if keep == "smallest" else F.max
    exact = bodies.groupBy("digest", "body").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    split = cut(exact.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1").select("digest"))
    if not split.isEmpty():  # one digest for two texts: these groups are made anew, by text
        again = exact.join(split, "digest")
        members = bodies.groupBy("id", "digest", "body").agg(F.count(F.lit(1)).alias("n_rows"))
        found = found.join(split, "digest", "left_anti").unionByName(members.join(again, ["digest", "body"]).select(found.columns))
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
        "n_rows",
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest", memtables: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged, whatever their names; rows that repeat doc_id and text stay once.

    If such rows differ in other columns, one of them stays as it is; which one may change from run to run. Nulls, long
    texts and empty tables as in ``exact_duplicates``.
    """
    id_, digest, key, own = unused(docs, "__id", "__digest", "__key", "__own")
    stay = exact_duplicates(docs, keep, memtables).where("kept").select(F.col("doc_id").alias(id_), F.unhex("digest").alias(digest))
    mine = docs.withColumns({own: F.unhex(sha256_hex(text_or_empty())), key: F.col("doc_id").cast("long")})
    joined = mine.join(stay, F.col(key).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest)), "left_semi")
    return joined.dropDuplicates([key, own]).select(*docs.columns)
