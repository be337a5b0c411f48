"""Packing: optimal length buckets and token-budget batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import documents, stage

BUCKETS = 16
#: Tokens of a batch, padding included; a longer document is a batch of its own.
BUDGET = 65_536


def n_tokens(text: Column) -> Column:
    """White-space separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets of least padding, by dynamic programming.

    A bucket pads its documents to its upper bound; what is minimised is the sum
    of bounds over all documents.  Among equals the fewest buckets are taken.

    With the first i lengths packed at cost c[i], one more bucket up to length j
    costs c[i] + lengths[j] * (seen[j + 1] - seen[i]): lines in lengths[j] whose
    slopes fall with i, so a lower envelope gives each bucket's row in linear
    time, in whole numbers.
    """
    n = len(lengths)
    if n == 0:
        return []
    bound = [int(x) for x in lengths]
    seen = [0, *np.cumsum(counts).tolist()]
    cost: list[int | None] = [0, *[None] * n]
    back: list[list[int]] = []
    totals = []
    for _ in range(min(buckets, n)):
        hull: list[int] = []
        at, row, new = 0, [0] * n, [None] * (n + 1)
        for j in range(n):
            if cost[j] is not None:
                # Drop lines that the new one (of least slope so far) makes useless.
                while len(hull) >= 2:
                    p, q = hull[-2], hull[-1]
                    if (cost[j] - cost[p]) * (seen[q] - seen[p]) <= (cost[q] - cost[p]) * (seen[j] - seen[p]):
                        hull.pop()
                    else:
                        break
                hull.append(j)
            at = min(at, len(hull) - 1)
            if at < 0:
                at = 0
                continue
            x = bound[j]
            while at + 1 < len(hull) and cost[hull[at + 1]] - x * seen[hull[at + 1]] < cost[hull[at]] - x * seen[hull[at]]:
                at += 1
            row[j] = hull[at]
            new[j + 1] = cost[hull[at]] + x * (seen[j + 1] - seen[hull[at]])
        back.append(row)
        cost = new
        totals.append(cost[n])
    used = min((total, k) for k, total in enumerate(totals) if total is not None)[1]
    bounds, j = [], n
    for row in back[used::-1]:
        bounds.append(bound[j - 1])
        j = row[j - 1]
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket, bucket_len, batch, slot.

    The global histogram of lengths, exact, decides the buckets: one row for each
    length that occurs, which is no more than the longest document has words.
    Inside a bucket the documents, in the order of doc_id (nulls first, then
    length), fill batches of max(1, budget // bucket_len) documents.  Every
    document is placed once and whole; those without tokens (null and empty
    texts) count as length 1, rows that repeat get a place each, other columns
    are not read, and an empty table gives no rows.
    """
    sized = stage(docs.select("doc_id", n_tokens(F.col("text")).alias("n_tokens")).withColumn("length", F.greatest("n_tokens", F.lit(1))), "lengths")
    histogram = sized.groupBy("length").count().orderBy("length").toPandas()
    bounds = boundaries(histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets)
    bucket = sum(((F.col("length") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    bucketed = sized.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(F.array(*map(F.lit, bounds or [1])), F.col("bucket") + 1).cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Place of each row within its part and bucket; rows come sorted by bucket."""
        part, seen = TaskContext.get().partitionId(), np.zeros(max(1, len(bounds)), np.int64)
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            place = np.zeros(len(bucket), np.int64)
            for b in np.unique(bucket):
                mine = bucket == b
                place[mine] = seen[b] + np.arange(mine.sum())
                seen[b] += mine.sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(bucket), part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"])

    order = ["bucket", F.col("doc_id").asc_nulls_first(), "n_tokens"]
    placed = stage(
        bucketed.select("bucket", "doc_id", "n_tokens", "bucket_len")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(number, f"bucket int, doc_id {kind}, n_tokens long, bucket_len long, part int, place long"),
        "placed",
    )
    # At most one row for each part and bucket: parts are as many as shuffle partitions.
    counts = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("part")) - F.col("rows")
    offsets = counts.select("bucket", "part", before.alias("before"))
    index = F.col("before") + F.col("place")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    return placed.join(F.broadcast(offsets), ["bucket", "part"]).select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(index / per_batch).cast("long").alias("batch"), (index % per_batch).cast("long").alias("slot")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` of documents: 16 buckets, batches of 65,536 tokens; edge cases as there."""
    return pack(documents(spark, sf_dir))
