"""Cutting lineage in loops, and scratch folders: all in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What lets Spark delete the shuffles of a write at its end, and not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one becomes it where none is set (tests on one machine)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = have.get() if have.isDefined() else None
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="cribrum-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Everything written below the shared folder inside is deleted at the end, when the results have been written or read.

    DataFrames made inside can't be read afterwards.  Outside of such a scope the tables
    stay, as results are computed when they are asked for.
    """
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, read from a table that is written once (an eager checkpoint computes them twice)."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "cut")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out if they lie in fewer parts than there are cores, as those of a file of one row group do; else ``df``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count()
    return df.repartition(2 * cores) if parts < cores else df


def few(df: DataFrame, most: int) -> bool:
    """Whether the table has at most that many rows, and so may be broadcast."""
    return df.limit(most + 1).count() <= most
