"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import text_bytes
from .tables import documents, hidden

EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 4, 32
#: A byte repeats if it ends GRAM bytes that also end at one of the LAGS bytes before.
GRAM, LAGS = 4, range(3, 25)
#: Chunks overlap by half and cover the whole document.
CHUNK = 1024
#: Training reads at most about this many labelled documents of each class, and none of more bytes.
PER_CLASS, TRAIN_BYTES = 1200, 1 << 15
STEPS, BATCH, RATE = 900, 24, 4e-3
CUT = 0.3


def chunks(raw: np.ndarray) -> np.ndarray:
    """The bytes as rows of CHUNK, each overlapping the one before by half, zero-padded."""
    half = CHUNK // 2
    n = max(1, -(-len(raw) // half) - 1)
    padded = np.zeros((n + 1) * half, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::half]


def repeats(rows: np.ndarray) -> np.ndarray:
    """The second input channel: 1 where a byte repeats what stands shortly before it in its chunk."""
    flag = np.zeros(rows.shape, bool)
    for lag in LAGS:
        same = (rows[:, lag:] == rows[:, :-lag]) & (rows[:, lag:] != 0)
        run = same[:, GRAM - 1 :].copy()
        for i in range(1, GRAM):
            run &= same[:, GRAM - 1 - i : -i]
        flag[:, lag + GRAM - 1 :] |= run
    return flag.astype(np.float32)


@dataclass
class ByteNet:
    """Embedding and repeat channel, one convolution, max pooling per chunk, mean over chunks, logistic output."""

    embed: np.ndarray
    filters: np.ndarray
    again: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    @staticmethod
    def new(seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        embed[0] = 0
        filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        again = rng.normal(0, WIDTH**-0.5, (WIDTH, FILTERS)).astype(np.float32)
        return ByteNet(embed, filters, again, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def patches(self, rows: np.ndarray) -> np.ndarray:
        """Bytes under each filter position: (chunks, positions, WIDTH)."""
        return np.lib.stride_tricks.sliding_window_view(rows, WIDTH, axis=1)[:, ::STRIDE]

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Max-pooled activations of each chunk, where they were, and the patches of both channels."""
        patches, flags = self.patches(rows), np.ascontiguousarray(self.patches(repeats(rows)))
        values = self.embed[patches].reshape(patches.shape[0], patches.shape[1], WIDTH * EMBED) @ self.filters + flags @ self.again
        where = values.argmax(axis=1)
        return np.maximum(np.take_along_axis(values, where[:, None], 1)[:, 0] + self.bias, 0), where, patches, flags

    def scores(self, raws: list[np.ndarray]) -> np.ndarray:
        """One probability a document; chunks go through in bounded blocks."""
        owner, rows, sums = [], [], np.zeros((len(raws), FILTERS), np.float64)
        counts = np.array([max(1, -(-len(r) // (CHUNK // 2)) - 1) for r in raws])
        held = 0

        def flush():
            nonlocal owner, rows, held
            if rows:
                np.add.at(sums, np.concatenate(owner), self.pooled(np.concatenate(rows))[0])
            owner, rows, held = [], [], 0

        for i, raw in enumerate(raws):
            view = chunks(raw)
            for lo in range(0, len(view), 64):
                part = view[lo : lo + 64]
                rows.append(part)
                owner.append(np.full(len(part), i))
                held += len(part)
                if held >= 64:
                    flush()
        flush()
        return 1 / (1 + np.exp(-((sums / counts[:, None]) @ self.out + self.shift)))

    def gradients(self, raws: list[np.ndarray], target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        views = [chunks(r) for r in raws]
        counts = np.array([len(v) for v in views])
        owner = np.repeat(np.arange(len(raws)), counts)
        pooled, where, patches, flags = self.pooled(np.concatenate(views))
        mean = np.zeros((len(raws), FILTERS), np.float32)
        np.add.at(mean, owner, pooled)
        mean /= counts[:, None]
        p = 1 / (1 + np.exp(-(mean @ self.out + self.shift)))
        slope = ((p - target) * weight / weight.sum()).astype(np.float32)
        back = ((slope[owner] / counts[owner])[:, None] * self.out * (pooled > 0)).astype(self.filters.dtype)
        # Only the bytes under each filter's maximum take part: (chunks, FILTERS, WIDTH).
        row = np.arange(len(owner))[:, None]
        under = patches[row, where]
        filters = np.einsum("cf,cfx->xf", back, self.embed[under].reshape(*where.shape, -1), optimize=True)
        again = np.einsum("cf,cfw->wf", back, flags[row, where], optimize=True)
        below = back[:, :, None, None] * self.filters.T.reshape(FILTERS, WIDTH, EMBED)
        embed = np.stack([np.bincount(under.ravel(), below[..., e].ravel(), 256) for e in range(EMBED)], axis=1).astype(self.embed.dtype)
        embed[0] = 0
        return [embed, filters, again, back.sum(axis=0), slope @ mean, np.array([slope.sum()], np.float32)]


def fit(raws: list[np.ndarray], labels: np.ndarray, prior: float = 0.5, seed: int = 7) -> ByteNet:
    """Adam on the logistic loss, STEPS steps over documents in a fixed shuffled order.

    ``prior`` is the share of label 1 where the sample comes from, which the classes weigh by.
    """
    net = ByteNet.new(seed)
    state = [net.embed, net.filters, net.again, net.bias, net.out, net.shift]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    share = max(1e-3, labels.mean())
    weights = np.where(labels == 1, prior / share, (1 - prior) / max(1e-3, 1 - share))
    rng, order = np.random.default_rng(seed), np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(raws))])
        pick, order = order[:BATCH], order[BATCH:]
        rate = RATE * (1 - 0.9 * step / STEPS)
        for i, g in enumerate(net.gradients([raws[k] for k in pick], labels[pick], weights[pick])):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.98 * second[i] + 0.02 * g * g
            state[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.98**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ByteNet | None:
    """Learn from labelled rows that are not held out; None if there is none.

    The sample is bounded: about ``per_class`` documents of each label, chosen
    by a hash of doc_id, of at most TRAIN_BYTES each.  A document with several
    labels has the greatest, one with several texts gives each; nulls in either
    table are left out.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return None
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("lot")
    share = F.when(F.col("quality") == 1, F.lit(per_class / counts.get(1, 1))).otherwise(F.lit(per_class / counts.get(0, 1)))
    # At most 4 * per_class ids: bounded, so broadcast, and the documents stay where they are.
    chosen = known.select("doc_id", "quality", lot).where(F.col("lot") < share * (1 << 30)).orderBy("lot", "doc_id").limit(4 * per_class)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("lot", "doc_id", "text").limit(4 * per_class).select("doc_id", "quality", "text").collect()
    rows = sorted((r.doc_id, r.quality, r.text) for r in rows)
    if not rows:
        return None
    prior = counts.get(1, 0) / sum(counts.values())
    return fit([np.frombuffer(t.encode(), np.uint8) for _, _, t in rows], np.array([float(q == 1) for _, q, _ in rows]), prior)


def score(docs: DataFrame, net: ByteNet | None, keep: list[str], name: str = "score") -> DataFrame:
    """The columns in ``keep`` and ``name``: how likely label 1 is, from the bytes of the whole text alone.

    Null counts as empty, and empty texts get a score too; without any labelled
    row to learn from, every score is 0.5.  Long texts are scored whole, 64 chunks
    at a time; rows that repeat get equal scores, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data, offsets = text_bytes(part.column("text"))
                raws = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                value = net.scores(raws) if net is not None else np.full(len(raws), 0.5)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(value.astype(np.float64))], names=[*keep, name])

    table = docs.select(*dict.fromkeys([*keep, "text"]))
    return table.mapInArrow(run, T.StructType([*(table.schema[c] for c in keep), T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, all_docs: DataFrame | None = None) -> DataFrame:
    """The documents whose score reaches CUT, with all their columns, whatever their names; as ``score`` otherwise."""
    table, _ = hidden(docs, ["doc_id", "text"])
    scored = score(table, train(docs if all_docs is None else all_docs, labels), table.columns, "_likely")
    return scored.where(F.col("_likely") >= CUT).select(*table.columns).toDF(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` of documents and whether it reaches CUT, learned from the labels of crc32(doc_id) mod 5 other than 0; edge cases as there."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    table = docs.withColumn("held_out", held_out(F.col("doc_id")))
    scored = score(table, train(docs, labels), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
