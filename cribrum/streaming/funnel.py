"""A funnel over arriving files: incremental, resumable, with counters."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.filters import first_failure


def arriving(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder; ``files_per_trigger`` bounds what is in flight."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


class _Counters(StreamingQueryListener):
    """The counters of every micro-batch of one query, however many there are (``recentProgress`` keeps the last hundred)."""

    def __init__(self):
        self.batches: dict[int, dict] = {}
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get("funnel")
        if row is not None:
            seconds = p.batchDuration / 1000
            self.batches[p.batchId] = row.asDict() | {"batch": p.batchId, "seconds": seconds, "rate": row["raw"] / seconds if seconds else None}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def run_to_sink(stream: DataFrame, steps: list[tuple[str, Column]], target: str, checkpoint: str) -> list[dict]:
    """Append survivors to Parquet under ``target`` until no file is left; counters, seconds and rows a second of each micro-batch.

    The checkpoint holds what was read and committed: after a stop the next run
    goes on exactly there, and files are never read twice.
    """
    counters, spark = _Counters(), stream.sparkSession
    tagged = stream.withColumn("_why", first_failure(steps))
    watched = tagged.observe("funnel", F.count(F.lit(1)).alias("raw"), *[F.count_if(F.col("_why") == name).alias(f"fail_{name}") for name, _ in steps], F.count_if(F.col("_why") == "out").alias("out"))
    spark.streams.addListener(counters)
    try:
        query = watched.where("_why = 'out'").drop("_why").writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        # Events come in order, the end last.
        if not counters.ended.wait(120):
            raise TimeoutError("the counters of the stream did not arrive")
    finally:
        spark.streams.removeListener(counters)
    return [counters.batches[b] for b in sorted(counters.batches)]


def run_idempotent(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch with its number to ``write``; a batch that is repeated after a failure has the same number."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def rollup_writer(target: str) -> Callable[[DataFrame, int], None]:
    """Writes batch n to ``target``/batch=n, over what an earlier try may have left."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write
