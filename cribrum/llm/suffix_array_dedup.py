"""Suffix-array dedup: distributed prefix doubling over sampled byte positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import KEY, OPEN, Stretches, Windows, keep_pieces, remove_repeats
from .tables import documents, in_order, stage

WIDTH = 200
#: Groups of more stretches than this are sorted window by window over all tasks, not as one group.
CROWD = 4096


def _spec(width: int) -> Windows:
    return Windows(words=False, width=width, block=max(1, width // 5), gram=max(1, width // 10))


def rerank(state: DataFrame, name: str) -> DataFrame:
    """Sort the pairs of rank and ``name``, the block at the next offset; their order is the new rank.

    Positions whose pair is unique are dropped: nothing longer that starts there repeats.
    """
    pairs = state.groupBy("rank", name).agg(F.sum("n").alias("size")).where("size > 1").select("rank", name)
    ranks = stage(in_order(pairs, ["rank", name], "next"), "ranks")
    return stage(state.join(ranks, ["rank", name]).drop("rank").withColumnRenamed("next", "rank"), "ranked")


def prefix_doubling(nodes: DataFrame) -> DataFrame:
    """Ranks of sampled positions by their first block (``ha``), then by the pair of that and the next block (``hb``).

    Beyond two blocks a window may end, so from there on windows themselves are
    the positions: see ``_sorted_windows``.
    """
    state = nodes.withColumn("rank", F.lit(0).cast("long"))
    for name in ("ha", "hb"):
        state = rerank(state, name)
    return state


def _repeats_by_doubling(spec: Windows, batch) -> pa.RecordBatch:
    """Prefix doubling over the windows of a batch: ranks at a quarter, half and the whole of the width.

    A rank is the place of a position among all sorted by (rank, rank at the
    offset); positions that are unique get rank 0 and drop out at longer widths.
    """
    have = Stretches.of(spec, batch)
    length = max(1, spec.width // 4)
    key = spec.names(have.chunk).all(length)
    while length < spec.width:
        _, rank, count = np.unique(key, return_inverse=True, return_counts=True)
        rank = np.where(count[rank] > 1, rank + 1, 0)
        # The last step may overlap, so that it ends at the width exactly.
        step = min(length, spec.width - length)
        left, right = rank[: len(rank) - step], rank[step:]
        # Positions without a rank are told apart by where they are.
        key = np.where((left > 0) & (right > 0), (left << 32) | right, -1 - np.arange(len(left)))
        length += step
    # Other positions run from one stretch into the next.
    _, rank, count = np.unique(key[have.at], return_inverse=True, return_counts=True)
    repeated = count[rank] > 1
    return have.spans(spec, repeated & (have.kind[have.owner] == OPEN))


def _sorted_groups(spec: Windows, crowd: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by group; whole groups are taken together, several at a time."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        group = held.column("rank").to_numpy()
        edge = np.flatnonzero(group[1:] != group[:-1]) + 1
        if held.num_rows >= 2 * crowd and len(edge):
            cuts = [0, *edge[np.searchsorted(edge, np.arange(crowd, edge[-1], crowd))], edge[-1]]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    yield _repeats_by_doubling(spec, held.slice(a, b - a))
            held = held.slice(int(edge[-1]))
    if held is not None and held.num_rows:
        yield _repeats_by_doubling(spec, held)


def _window_rows(spec: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a window: the names of its two halves (which overlap where the width is odd)."""
    half = -(-spec.width // 2)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            have = Stretches.of(spec, batch.slice(lo, 1024))
            names = spec.names(have.chunk)
            columns = [*(key[have.owner] for key in have.keys), have.start, have.kind[have.owner]]
            halves = [names.at(x, x + half).view(np.int64) for x in (have.at, have.at + spec.width - half)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns + halves], names=[*KEY, "start", "kind", "x", "y"])


def _sorted_windows(spec: Windows, crowd: int, stretches: DataFrame) -> DataFrame:
    """Runs k, j, start, stop of open windows that repeat.

    Equal windows lie in stretches of one group.  Small groups are sorted each
    in one task; the windows of crowded ones by Spark, by the pair of the names
    of their halves.
    """
    small = (
        stretches.where("not crowd")
        .repartition("rank")
        .sortWithinPartitions("rank")
        .mapInArrow(lambda b: _sorted_groups(spec, crowd, b), "k long, j int, start long, stop long")
    )
    windows = stretches.where("crowd").mapInArrow(lambda b: _window_rows(spec, b), "k long, j int, start long, kind int, x long, y long")
    pairs = windows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y")
    crowded = windows.where(F.col("kind") == OPEN).join(pairs, ["x", "y"], "left_semi").select(*KEY, "start", (F.col("start") + spec.width).alias("stop"))
    return small.unionByName(crowded)


def _remove(docs: DataFrame, width: int, finish, fields: str, carry: list[str]) -> DataFrame:
    spec, crowd = _spec(width), CROWD
    return remove_repeats(docs, spec, prefix_doubling, lambda s: _sorted_windows(spec, crowd, s), crowd, finish, T.StructType.fromDDL(fields).fields, carry)


def _digest(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple:
    return len(raw), int((stops - starts).sum()), len(starts), hashlib.sha256(keep_pieces(raw, starts, stops)).hexdigest()


def _text(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple:
    text = keep_pieces(raw, starts, stops).decode("utf-8", "ignore")
    return text, len(text)


def digest_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a ``width``-byte string that starts at two places or
    more of the corpus (one document or several; overlaps count) is removed, all
    occurrences alike.  Null and empty texts have no bytes, nulls in doc_id are
    kept, and rows that repeat repeat each other.  Very long texts are scanned a
    megabyte at a time.  Other columns are not read; an empty table gives no rows.
    """
    return _remove(docs, width, _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id"])


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with the repeated bytes gone from text, and n_chars counted anew.

    A character of which a cut leaves only a part goes with it.  Null texts
    become empty; rows stay, and so do columns besides text and n_chars,
    whatever their names.  Otherwise as ``digest_repeats``.
    """
    carry = [c for c in docs.columns if c not in ("text", "n_chars")]
    own = [f"_o{i}" for i in range(len(carry))]
    out = _remove(docs, width, _text, "text string, n_chars long", carry).toDF(*own, "text", "n_chars")
    order = dict(zip(carry, own)) | {"text": "text", "n_chars": "n_chars"}
    return out.select(*(order[c] for c in docs.columns)).toDF(*docs.columns)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``digest_repeats`` of documents: strings of 200 bytes; edge cases as there."""
    return digest_repeats(documents(spark, sf_dir))
