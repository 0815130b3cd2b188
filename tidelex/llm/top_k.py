"""Exact top-k search by inner product: tiled matrix products and a tree of merged lists.

Queries are dealt into blocks and candidates into shards. Each (block, shard) tile is one matrix product in one
task, of which only the k best per query leave the task. The per-tile lists then merge in a tree of fixed fan-in,
so no task ever holds more than ``FAN_IN`` lists of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm.common import cut

FAN_IN = 8
#: A table of fewer vectors is still dealt to so many shards, of so many rows at least.
MIN_SHARDS, MIN_SHARD_ROWS = 16, 2048
TOPS = "array<struct<score:long,vec_id:long>>"


def quantised(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v array<long>: floor(scale * component); rows with a null id, a null vector or null or non-finite components take no part.

    A finite component whose scaled value does not fit 64 bits is an error. Other columns are not read.
    """
    comp = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(comp, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    too_large = F.raise_error(F.lit("a scaled component does not fit 64 bits")).cast("long")
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**63), F.floor(x)).otherwise(too_large)
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(comp, lambda x: whole(F.lit(scale) * x)).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.int64)


def _largest(m: np.ndarray) -> int:
    return max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))


def tile_top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each query in turn scores and ids of its k best candidates of this tile, by score and then the smaller id, itself left out.

    Products are exact: in doubles or 64 bits where the tile's largest components allow it, else in Python integers.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    bound = _largest(q) * _largest(c) * max(1, q.shape[1])
    kind = np.float64 if bound < 1 << 52 else np.int64 if bound < 1 << 63 else object  # what holds every partial sum
    left, right = q.astype(kind), c.T.astype(kind)
    for at in range(0, len(q), 256):
        scores = left[at : at + 256] @ right
        for row, me in zip(scores, q_ids[at : at + 256], strict=True):
            others = np.flatnonzero(c_ids != me)
            s = row[others]
            if kind is object and _largest(s) >= 1 << 63:
                raise OverflowError("an inner product does not fit 64 bits")
            s = s.astype(np.int64)
            if len(s) > k:  # everything above the k-th score, then ties in id order
                kth = np.partition(s, len(s) - k)[len(s) - k]
                above, ties = np.flatnonzero(s > kth), np.flatnonzero(s == kth)
                pick = np.concatenate([above, ties[: k - len(above)]])
            else:
                pick = np.arange(len(s))
            yield s[pick], c_ids[others[pick]]


def narrowest(largest: int) -> str:
    """The smallest integer type for values of this size."""
    return next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if largest < 1 << bits or bits == 63)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 32_768, shard_rows: int = 32_768) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Both frames are (vec_id long, v array<long>). Rows of the query's own id are not its candidates; with fewer than k
    candidates all are returned, with none the query has no row. Vectors of another length than the query's are not
    compared. Every row counts: a repeated query row has its list again, a repeated candidate row is a candidate again,
    and rows of one id with other vectors are queries or candidates of their own. Tables without rows give none. An
    inner product that does not fit 64 bits is an error.

    Equal rows are counted before they are dealt: of a candidate at most k are, and a query is searched once. With the
    default sizes both sides move once for every 32,768 rows of the other.
    """
    queries = cut(queries.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("own", F.monotonically_increasing_id()))
    vectors = cut(vectors.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times")))
    size = F.struct(F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("v"), F.bitwise_not(F.array_min("v")))).alias("most"))
    q_size, c_size = queries.agg(size).first()[0], vectors.agg(size).first()[0]
    n_blocks = max(1, -(-q_size.n // block_rows))
    n_shards = max(1, -(-c_size.n // shard_rows), min(MIN_SHARDS, c_size.n // MIN_SHARD_ROWS))
    dealt = lambda df, n, size: df.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")).withColumn("dim", F.size("v")).withColumn("v", F.col("v").cast(f"array<{narrowest(size.most or 0)}>"))
    tiles = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    again = F.explode(F.array_repeat(F.col("vec_id"), F.col("times")))
    left = dealt(queries, n_blocks, q_size).select(F.col("part").alias("block"), tiles(n_shards).alias("shard"), "dim", "own", F.col("vec_id").alias("q_id"), F.col("v").alias("q"))
    right = dealt(vectors, n_shards, c_size).select("part", "dim", again.alias("c_id"), F.col("v").alias("c"))
    right = right.select(tiles(n_blocks).alias("block"), F.col("part").alias("shard"), "dim", "c_id", "c")

    def tile(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        tops = []
        if q.num_rows and c.num_rows:
            for scores, who in tile_top_k(q["q_id"].to_numpy(), _matrix(q["q"]), c["c_id"].to_numpy(), _matrix(c["c"]), k):
                tops.append([{"score": int(s), "vec_id": int(w)} for s, w in zip(scores, who, strict=True)])
        kind = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))
        found = q.slice(0, len(tops))
        return pa.table({"own": found["own"], "query_id": found["q_id"], "node": pa.array([key[1].as_py()] * len(tops), pa.int32()), "tops": pa.array(tops, kind)})

    by = ["block", "shard", "dim"]
    lists = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, f"own long, query_id long, node int, tops {TOPS}")
    while True:
        order = lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.vec_id < b.vec_id, -1).when(a.vec_id > b.vec_id, 1).otherwise(0)
        best = F.slice(F.array_sort(F.flatten(F.collect_list("tops")), order), 1, k)
        lists = lists.groupBy("own", "query_id", F.floor(F.col("node") / FAN_IN).cast("int").alias("node")).agg(best.alias("tops"))
        if n_shards <= FAN_IN:
            break
        n_shards = -(-n_shards // FAN_IN)
    lists = lists.join(queries.select("own", "times"), "own").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return lists.select("query_id", F.posexplode("tops").alias("at", "top")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "top.vec_id", "top.score")
