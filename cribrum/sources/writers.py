"""Writing tables: formats, layout, compaction, restart by group, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_any(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header for .csv, tab-separated for .tsv, else Parquet."""
    writer = df.write.mode(mode)
    if path.endswith((".csv", ".tsv")):
        writer.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    else:
        writer.parquet(path)


def convert(spark: SparkSession, source: str, target: str, schema: str, codec: str = "zstd", rows_per_file: int = 0, row_group_bytes: int = 128 << 20, files: int = 0) -> DataFrame:
    """CSV to Parquet, never over existing output; returns one row: rows, files, their bytes and row groups."""
    rows = spark.read.option("header", True).schema(schema).csv(source)
    writer = (rows.coalesce(files) if files else rows).write.mode("errorifexists").option("compression", codec).option("parquet.block.size", row_group_bytes)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(target)
    out = spark.read.parquet(target)
    files = out.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size"))
    one = files.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return one.crossJoin(row_groups(out).agg(F.sum("groups").alias("row_groups")))  # one row each


def row_groups(table: DataFrame) -> DataFrame:
    """The number of row groups of each Parquet file of a table, from the footers alone, which the driver's reader of file systems gives.

    One footer is read at a time; the driver lists the files anyway.
    """
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for file in table.inputFiles():
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            found.append((file, reader.getFooter().getBlocks().size()))
        finally:
            reader.close()
    return spark.createDataFrame(found, "file string, groups long")


def roll_up(spark: SparkSession, source: str, target: str, every: int) -> DataFrame:
    """Shards in the order of their names into rollups under ``target``; per rollup: shards and rows.

    A rollup ends with the shard that brings it to ``every`` rows, so all but the last
    have so many at least.  ``streaming.parts`` does the same while shards arrive.
    """
    shards = spark.read.option("mergeSchema", True).parquet(source)
    # One row a file, which the driver lists anyway.
    sizes = sorted(shards.groupBy(F.col("_metadata.file_path").alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect())
    placed, rollup, have = [], 0, 0
    for shard, n in sizes:
        placed.append((shard, rollup, n))
        have += n
        if have >= every:
            rollup, have = rollup + 1, 0
    log = spark.createDataFrame(placed, "shard string, rollup int, n long")
    rows = shards.withColumn("shard", F.col("_metadata.file_path")).join(F.broadcast(log.select("shard", "rollup")), "shard").drop("shard")
    rows.repartition("rollup").write.mode("errorifexists").partitionBy("rollup").parquet(target)
    return log.groupBy("rollup").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("rows"))


def compact(spark: SparkSession, source: str, target: str, files: int) -> DataFrame:
    """Rewrite many small parts, of columns that may differ, as ``files`` parts; rows before and after."""
    parts = spark.read.option("mergeSchema", True).parquet(source)
    parts.repartition(files).write.mode("errorifexists").parquet(target)
    before, after = (df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((parts, "part_rows"), (spark.read.parquet(target), "final_rows")))
    return before.crossJoin(after).withColumn("equal", F.col("part_rows") == F.col("final_rows"))  # one row each


def write_groups(df: DataFrame, group: str, path: str) -> None:
    """One folder a group; reading the parent folder gives all."""
    df.write.mode("errorifexists").partitionBy(group).parquet(path)


def write_missing_groups(df: DataFrame, group: str, path: str) -> list[str]:
    """Write only groups that the output lacks; those written are returned (one name a group)."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(F.col(group).cast("string").alias("_g")).distinct()
        rest = df.join(done, df[group].cast("string") == F.col("_g"), "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        rest = df
    names = [r[0] for r in rest.select(F.col(group).cast("string")).distinct().orderBy(group).collect()]
    if names:
        rest.write.mode("append").partitionBy(group).parquet(path)
    return names


def run_summary(df: DataFrame, counts: dict[str, Column], breakdowns: list[str], path: str) -> DataFrame:
    """Counters and breakdowns as one nested JSON row, written and read back."""
    one = df.agg(F.struct(*[c.alias(n) for n, c in counts.items()]).alias("counts"))
    for name in breakdowns:
        rows = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        one = one.crossJoin(rows.agg(F.array_sort(F.collect_list(F.struct(F.col(name).cast("string").alias("value"), "n"))).alias(f"by_{name}")))  # one row
    one.coalesce(1).write.mode("errorifexists").json(path)
    return df.sparkSession.read.schema(one.schema).json(path)


def export(df: DataFrame, order: list[str], top: int | None = None, by: str | None = None, key: str | None = None) -> DataFrame:
    """The known columns in their order, those that are missing left out; optionally the ``top`` rows by a score."""
    out = df.select(*[c for c in order if c in df.columns])
    return out.orderBy(F.desc_nulls_last(by), key).limit(top) if top is not None else out
