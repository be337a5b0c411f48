"""Where the multi-step operators keep what they have computed so far, and what they share over DataFrames.

Lineage is cut by Parquet tables in the cluster's shared folder, which every
executor and the driver can reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import few, scratch

__all__ = ["documents", "few", "hidden", "in_order", "new_path", "stage", "text_key"]


def new_path(spark: SparkSession, name: str) -> str:
    return scratch(spark, f"cribrum-{name}")


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    With ``narrow`` in two parts a core at most: for tables of links and labels, which
    are small beside the corpus, so that they don't become a file for each shuffle partition.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df = df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hidden(df: DataFrame, used: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The table with all columns but ``used`` under names of our own, and the new name of each column.

    So columns whose names hold dots or back-quotes, differ from ours in case only
    or are those of intermediate columns don't disturb.  Column order stays, so
    ``toDF(*df.columns)`` undoes it.
    """
    names = {c: c if c in used else f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def in_order(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Adds whole numbers that rise with ``columns``: rows are sorted over range partitions and numbered within them."""
    ordered = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return ordered.withColumn(name, F.monotonically_increasing_id())


def text_key(text: Column) -> Column:
    """128 bits that stand for a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
