"""Pairs of vectors at a cosine of a threshold or more, within shared keys, by matrix products of blocks.

A key's vectors are dealt to blocks of a bounded number of rows, and each block of the left side meets each block of the
right side in one task. A row moves once for every block of the other side of its key, so up to BLOCK_ROWS rows of a
key move once; only what is close leaves a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8192


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Rows scaled to unit length; a zero vector stays as it is and is close to none."""
    flat = column.combine_chunks()
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def _dealt(rows: DataFrame, on: list[str], key: str, vector: str, sizes: DataFrame, mine: str, other: str, names: tuple[str, str, str]) -> DataFrame:
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    ready = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).join(sizes, on)
    own, across = F.pmod(F.xxhash64(key), blocks(mine)).cast("int").alias(names[0]), F.explode(F.sequence(F.lit(0), blocks(other) - 1)).alias(names[1])
    return ready.select(*[F.col(c).alias(c) for c in on], F.col(key).alias(names[2]), F.col(vector).alias("v"), F.size(vector).alias("dim"), own, across)


def _tiles(left: DataFrame, right: DataFrame, on: list[str], key: str, vector: str):
    count = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    sizes = count(left, "__n").join(count(right, "__m"), on)
    by = [*on, "__i", "__j", "dim"]
    a = _dealt(left, on, key, vector, sizes, "__n", "__m", ("__i", "__j", "a"))
    b = _dealt(right, on, key, vector, sizes, "__m", "__n", ("__j", "__i", "b"))
    return a.groupBy(*by).cogroup(b.groupBy(*by)), left.schema[key].dataType.simpleString()


def close_pairs(left: DataFrame, right: DataFrame, on: list[str], key: str, vector: str, threshold: float, ordered: bool = False) -> DataFrame:
    """a, b, cosine: keys of close rows that share ``on``, with ``ordered`` those of a < b only.

    Null keys of ``on``, null vectors and vectors that hold a null are close to none; vectors of different lengths are not compared.
    """
    grouped, kind = _tiles(left, right, on, key, vector)

    def compare(_: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if not (x.num_rows and y.num_rows):
            return pa.table({"a": x["a"].slice(0, 0), "b": y["b"].slice(0, 0), "cosine": pa.array([], pa.float64())})
        u, v = _units(x["v"]), _units(y["v"])
        at, to, along = [], [], []
        for k in range(0, len(u), 512):
            c = u[k : k + 512] @ v.T
            i, j = np.nonzero(c >= threshold)
            at.append(i + k)
            to.append(j)
            along.append(c[i, j])
        a, b = x["a"].take(pa.array(np.concatenate(at))), y["b"].take(pa.array(np.concatenate(to)))
        return pa.table({"a": a, "b": b, "cosine": pa.array(np.concatenate(along))})

    found = grouped.applyInArrow(compare, f"a {kind}, b {kind}, cosine double")
    return found.where("a < b") if ordered else found


def close_to_any(left: DataFrame, right: DataFrame, on: list[str], key: str, vector: str, threshold: float) -> DataFrame:
    """``on`` and key of the left rows that are close to any right row of their ``on``, each once."""
    grouped, kind = _tiles(left, right, on, key, vector)

    def compare(_: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        names = [*on, "a"]
        if not (x.num_rows and y.num_rows):
            return x.select(names).slice(0, 0)
        u, v = _units(x["v"]), _units(y["v"])
        hit = np.concatenate([(u[k : k + 512] @ v.T >= threshold).any(axis=1) for k in range(0, len(u), 512)])
        return x.select(names).filter(pa.array(hit))

    schema = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in on) + f", a {kind}"
    return grouped.applyInArrow(compare, schema).distinct().withColumnRenamed("a", key)
