"""Tables that jobs keep between their steps, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir`` or set on the context.

    Where neither is set, a session on one machine (as in tests) gets a temporary folder and any other an error, as no
    folder of the driver's machine would be seen by the executors.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidelex-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute now and keep the rows in the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidelex/{name}-{uuid.uuid4().hex}"
    for paths in _temporary:
        paths.append(path)
    return path


_temporary: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what ``scratch`` and ``kept`` made within; results have to be written or collected before.

    Checkpoints are Spark's own: ``spark.cleaner.referenceTracking.cleanCheckpoints`` has them deleted.
    """
    paths: list[str] = []
    _temporary.append(paths)
    try:
        yield
    finally:
        _temporary.remove(paths)
        for path in paths:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def kept(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The rows as a compressed Parquet table in the shared folder, read back; smaller than a checkpoint for wide rows."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
