"""The digest index over several batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelex.llm import queries
from tidelex.llm.exact_dedup import DigestIndex


def test_digest_index_goes_on_after_compaction(spark):
    index = DigestIndex(spark, keep="smallest")
    digest = F.unhex(F.sha2((F.col("id") % 10).cast("string"), 256))
    for at in (0, 100, 200):
        index.insert(spark.range(at, at + 100).select("id", digest.alias("digest")))
        index.compact()
    assert len(index.runs) == 1 and sorted((r.keep_id, r.n) for r in index.read().collect()) == [(k, 30) for k in range(10)]


def test_repeated_rows_each_come_back(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (3, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True), (3, 3, 2, True), (3, 3, 2, True)]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in queries.op1_exact_dedup(spark, str(tmp_path)).collect()) == want
