"""Substring dedup: level-wise doubling over word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import KEY, OPEN, Stretches, Windows, remove_repeats
from .tables import documents, stage

WIDTH = 35


def _spec(width: int) -> Windows:
    return Windows(words=True, width=width, block=max(1, width // 4), gram=max(1, width // 9))


def extend_blocks(nodes: DataFrame) -> DataFrame:
    """The nodes whose windows of one block repeat, extended to two blocks; those that repeat still are left.

    ``rank`` is the pair's group: a hash of the names of both blocks.
    """
    names: list[str] = []
    for block in ("ha", "hb"):
        names.append(block)
        repeated = nodes.groupBy(*names).agg(F.sum("n").alias("size")).where("size > 1").select(*names)
        nodes = stage(nodes.join(repeated, names, "left_semi"), "level")
        if nodes.isEmpty():
            break
    return nodes.withColumn("rank", F.xxhash64("ha", "hb"))


def _levels(spec: Windows) -> list[int]:
    """Lengths beyond two blocks: doubled each time, the last one the width."""
    lengths, length = [], 2 * spec.block
    while length < spec.width:
        length = min(2 * length, spec.width)
        lengths.append(length)
    return lengths or [spec.width]


def _window_rows(spec: Windows, lengths: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a window of each stretch: where it starts and its name at each level."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            have = Stretches.of(spec, batch.slice(lo, 4096))
            names = spec.names(have.chunk)
            columns = [*(key[have.owner] for key in have.keys), have.start, have.kind[have.owner]]
            columns += [names.at(have.at, have.at + n).view(np.int64) for n in lengths]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*KEY, "start", "kind", *(f"w{n}" for n in lengths)])


def extend_windows(spec: Windows, stretches: DataFrame) -> DataFrame:
    """Runs k, j, start, stop of open windows that repeat.

    Level by level: windows repeated at one length alone are extended to twice
    that length, up to the width, until no candidates survive.
    """
    lengths = _levels(spec)
    kinds = "k long, j int, start long, kind int, " + ", ".join(f"w{n} long" for n in lengths)
    level = stage(stretches.mapInArrow(lambda b: _window_rows(spec, lengths, b), kinds), "windows")
    for n in lengths:
        repeated = level.groupBy(f"w{n}").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(f"w{n}")
        level = stage(level.join(repeated, f"w{n}", "left_semi"), "level")
        if level.isEmpty():
            break
    return level.where(F.col("kind") == OPEN).select(*KEY, "start", (F.col("start") + spec.width).alias("stop"))


def _remove(docs: DataFrame, width: int, finish, fields: str, carry: list[str]) -> DataFrame:
    spec = _spec(width)
    return remove_repeats(docs, spec, extend_blocks, lambda s: extend_windows(spec, s), 1 << 62, finish, T.StructType.fromDDL(fields).fields, carry)


def _kept(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[int, bytes]:
    words = raw.split()
    n = len(words)
    if not len(starts):
        return n, b" ".join(words)
    edges = [0, *(int(x) for pair in zip(starts, stops) for x in pair), n]
    return n, b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b])


def _digest(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple:
    n, kept = _kept(raw, starts, stops)
    return n, int((stops - starts).sum()), hashlib.sha256(kept).hexdigest()


def _text(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple:
    text = _kept(raw, starts, stops)[1].decode("utf-8")
    return text, len(text)


def digest_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256.

    Words are maximal runs of bytes other than ASCII white space, unchanged.
    Every word covered by a window of ``width`` words whose sequence also starts
    elsewhere (same document included) is removed.  Null and empty texts have no
    words, nulls in doc_id are kept, and rows that repeat repeat each other.
    Very long texts are scanned about a megabyte at a time.  Other columns are
    not read; an empty table gives no rows.
    """
    return _remove(docs, width, _digest, "n_words long, n_removed long, kept_sha256 string", ["doc_id"])


def drop_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with repeated words gone, kept words joined by one space, and n_chars counted anew.

    Columns besides text and n_chars stay, whatever their names; otherwise as ``digest_windows``.
    """
    carry = [c for c in docs.columns if c not in ("text", "n_chars")]
    own = [f"_o{i}" for i in range(len(carry))]
    out = _remove(docs, width, _text, "text string, n_chars long", carry).toDF(*own, "text", "n_chars")
    order = dict(zip(carry, own)) | {"text": "text", "n_chars": "n_chars"}
    return out.select(*(order[c] for c in docs.columns)).toDF(*docs.columns)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``digest_windows`` of documents: windows of 35 words; edge cases as there."""
    return digest_windows(documents(spark, sf_dir))
