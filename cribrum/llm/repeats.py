"""Exact removal of repeated windows: the kernels and the passes over documents that both dedup operators share.

Positions looked at are the anchors of ``anchors.py`` (about two in every
``choices`` symbols), found while the documents are scanned.  An anchor stands
for the windows that have it, which together cover a *stretch* of the text.
Equal stretches are one node with a count.  How nodes are told apart at growing
lengths, and how the windows of stretches that differ are compared, is for the
operators: ``suffix_array_dedup.py`` and ``substring_dedup.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import Names, byte_halves, segments, union_runs, window_anchors, word_halves, word_symbols
from .tables import hidden, stage

#: What identifies a document row: 96 bits of hashes of doc_id and text.
KEY = ["k", "j"]
#: A stretch: repeated as a whole; once only, its windows are open; repeated, and what open ones are compared with.
FULL, OPEN, BOTH = 0, 1, 2


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


@dataclass(frozen=True)
class Windows:
    """What counts as a repeat: ``width`` symbols; the rest only steers the search.

    ``block`` is the first length named; anchors are taken among the first
    ``choices`` positions of a window, so that two blocks always fit behind one.
    """

    words: bool
    width: int
    block: int
    gram: int

    @property
    def choices(self) -> int:
        return min(250, self.width - 2 * self.block + 1)

    def symbols(self, raw: np.ndarray) -> np.ndarray:
        return word_symbols(raw) if self.words else raw

    def names(self, symbols: np.ndarray) -> Names:
        return Names(word_halves(symbols) if self.words else byte_halves(symbols))

    def stretch(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first and last window start of a place."""
        at = place >> 16
        return at, at - ((place >> 8) & 255), at - (place & 255)


def _anchor_rows(spec: Windows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row an anchor: where it is, the names of the two blocks behind it and of its stretch.

    ``place`` packs the anchor and how far before it the first window starts and
    the last one ends to start.
    """
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in KEY]
        docs = [spec.symbols(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        for group in segments([len(d) for d in docs], spec.width):
            chunk = np.concatenate([docs[k][a:b] for k, a, b in group])
            sizes = np.array([b - a for _, a, b in group])
            names = spec.names(chunk)
            owner, at, first, last = window_anchors(sizes, names, spec.width, spec.choices, spec.gram)
            shift = np.array([a for _, a, _ in group]) - np.concatenate([[0], np.cumsum(sizes)[:-1]])
            place = ((at + shift[owner]) << 16) | ((at - first) << 8) | (at - last)
            row = np.array([k for k, _, _ in group])[owner]
            second = names.at(at + spec.block, at + 2 * spec.block) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(key[row]) for key in keys),
                    pa.array(place),
                    pa.array(names.at(at, at + spec.block).view(np.int64)),
                    pa.array(second.astype(np.int32)),
                    pa.array(names.at(first, last + spec.width).view(np.int64)),
                ],
                names=[*KEY, "place", "ha", "hb", "hc"],
            )


@dataclass
class Stretches:
    """A batch of stretches with their symbols, for the comparison of single windows."""

    keys: list[np.ndarray]
    kind: np.ndarray
    chunk: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(spec: Windows, batch) -> Stretches:
        """``at`` is where each window starts in ``chunk``, ``start`` where it starts in its document."""
        parts = [np.frombuffer(c, np.uint64 if spec.words else np.uint8) for c in batch.column("ctx").to_pylist()]
        sizes = np.array([len(p) for p in parts])
        counts = sizes - spec.width + 1
        owner = np.repeat(np.arange(len(parts)), counts)
        step = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        keys = [batch.column(c).to_numpy() for c in KEY]
        _, first, _ = spec.stretch(batch.column("place").to_numpy())
        return Stretches(keys, batch.column("kind").to_numpy(), np.concatenate(parts), begins[owner] + step, owner, first[owner] + step)

    def spans(self, spec: Windows, repeated: np.ndarray) -> pa.RecordBatch:
        """Rows k, j, start, stop: runs of the chosen windows of each stretch."""
        owner, start = self.owner[repeated], self.start[repeated]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(owner))[: len(first)] - 1
        return pa.RecordBatch.from_arrays(
            [*(pa.array(key[owner[first]]) for key in self.keys), pa.array(start[first]), pa.array(start[last] + spec.width)], names=[*KEY, "start", "stop"]
        )


_CTX_ARROW = pa.list_(pa.struct([("rank", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("crowd", pa.bool_()), ("ctx", pa.binary())]))
_CTX = "array<struct<rank:long,place:long,kind:int,crowd:boolean,ctx:binary>>"

Finish = Callable[[bytes, np.ndarray, np.ndarray], tuple]
#: Nodes (ha, hb, hc, n, first) to those whose blocks repeat, with their group as ``rank``.
TellApart = Callable[[DataFrame], DataFrame]
#: Stretches (k, j, rank, place, kind, crowd, ctx) to the runs (k, j, start, stop) of their open windows that repeat.
Compare = Callable[[DataFrame], DataFrame]


def keep_pieces(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """The bytes outside the runs."""
    if not len(starts):
        return raw
    edges = [0, *(int(x) for pair in zip(starts, stops) for x in pair), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(
    docs: DataFrame, spec: Windows, tell_apart: TellApart, compare: Compare, crowd: int, finish: Finish, fields: list[T.StructField], carry: list[str]
) -> DataFrame:
    """One row per document: the ``carry`` columns and what ``finish`` makes of it.

    ``docs`` has doc_id, text and the carried columns.  ``finish(raw, starts, stops)``
    gets the UTF-8 bytes of the whole text and the runs of symbols to remove.
    Null texts count as empty; rows alike in id and text share their key and so
    their runs, and repeat each other.
    """
    arrow_fields = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in fields])
    # Carried columns go by names of our own, whatever they are called.
    table, names = hidden(docs, ["doc_id", "text"])
    given, carry = carry, [names[c] for c in carry]
    carried = [T.StructField(c, table.schema[c].dataType) for c in carry]
    ident = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))]
    keyed = table.select(*carry, F.col("text").alias("_text"), F.xxhash64(*ident).alias("k"), F.hash(F.lit(7), *ident).alias("j"))

    # Counts come from partial aggregates and go back by joins whose two sides are tables of their own,
    # so that a block, pair or stretch that a third of all rows share is split over many tasks.
    anchors = keyed.select(*KEY, F.col("_text").alias("text")).mapInArrow(lambda b: _anchor_rows(spec, b), "k long, j int, place long, ha long, hb int, hc long")
    twice = stage(anchors.groupBy("ha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ha"), "blocks")
    kept = stage(anchors.join(twice, "ha", "left_semi"), "anchors")
    nodes = stage(kept.groupBy("ha", "hb", "hc").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "place")).alias("first")), "stretches")
    ranked = tell_apart(nodes)
    groups = stage(ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("stretches")).where("stretches > 1"), "groups")
    ranked = stage(ranked.join(groups, "rank", "left").withColumn("stretches", F.coalesce("stretches", F.lit(1))).where("n > 1 or stretches > 1"), "ranked")
    leads = F.col("first") == F.struct(*KEY, "place")
    marks = kept.join(ranked, ["ha", "hb", "hc"]).select(
        *KEY,
        "place",
        F.when(F.col("n") == 1, OPEN).when(leads & (F.col("stretches") > 1), BOTH).otherwise(FULL).alias("kind"),
        "rank",
        (F.col("stretches") > crowd).alias("crowd"),
    )
    # A set: rows that repeat as a whole have the same marks, which count once.
    of_doc = marks.groupBy(*KEY).agg(F.collect_set(F.struct("place", "kind", F.when(F.col("kind") != FULL, F.col("rank")).alias("rank"), "crowd")).alias("marks"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents whose marks are all of stretches that repeat as a whole are done; others give the symbols of the rest and wait."""
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                data, offsets = text_bytes(batch.column("_text"))
                marks = batch.column("marks")
                text, runs, ctxs, done = [], [], [], []
                for i in range(batch.num_rows):
                    raw = data[offsets[i] : offsets[i + 1]]
                    starts = stops = np.zeros(0, np.int64)
                    ctx = []
                    if marks[i].is_valid and len(marks[i].values):
                        m = marks[i].values
                        place, kind = (m.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                        _, first, last = spec.stretch(place)
                        starts, stops = union_runs(first[kind != OPEN], last[kind != OPEN] + spec.width)
                        if (kind != FULL).any():
                            symbols = spec.symbols(raw)
                            for c in np.flatnonzero(kind != FULL):
                                piece = symbols[first[c] : last[c] + spec.width].tobytes()
                                ctx.append({"rank": m.field(2)[c].as_py(), "place": int(place[c]), "kind": int(kind[c]), "crowd": m.field(3)[c].as_py(), "ctx": piece})
                    wait = any(c["kind"] == OPEN for c in ctx)
                    text.append(raw.tobytes() if wait else None)
                    runs.append([int(x) for x in np.concatenate((starts, stops))] if wait else None)
                    ctxs.append(ctx)
                    done.append((None,) * len(fields) if wait else finish(raw.tobytes(), starts, stops))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in [*carry, *KEY]]
                    + [pa.array(text, pa.binary()), pa.array(runs, pa.list_(pa.int64())), pa.array(ctxs, _CTX_ARROW)]
                    + [pa.array(x, f.type) for x, f in zip(zip(*done), arrow_fields)],
                    names=[*carry, *KEY, "_raw", "_runs", "_ctxs", *arrow_fields.names],
                )

    out = T.StructType([*carried, *T.StructType.fromDDL(f"k long, j int, _raw binary, _runs array<long>, _ctxs {_CTX}").fields, *fields])
    settled = stage(keyed.join(of_doc, KEY, "left").select(*carry, *KEY, "_text", "marks").mapInArrow(settle, out), "settled")

    # Rows that repeat give the same stretch twice, but none of these is open: it was counted twice.
    stretches = settled.select(*KEY, F.explode("_ctxs").alias("c")).select(*KEY, "c.*")
    found = compare(stretches).groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("found"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                done = []
                for raw, runs, more in zip(batch.column("_raw"), batch.column("_runs"), batch.column("found")):
                    runs = np.array(runs.as_py(), np.int64)
                    starts, stops = runs[: len(runs) // 2], runs[len(runs) // 2 :]
                    if more.is_valid:
                        starts = np.concatenate([starts, more.values.field(0).to_numpy()])
                        stops = np.concatenate([stops, more.values.field(1).to_numpy()])
                    done.append(finish(raw.as_py(), *union_runs(starts, stops)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in carry] + [pa.array(x, f.type) for x, f in zip(zip(*done), arrow_fields)],
                    names=[*carry, *arrow_fields.names],
                )

    waiting = settled.where("_raw is not null").select(*carry, *KEY, "_raw", "_runs")
    closed = waiting.join(found, KEY, "left").select(*carry, "_raw", "_runs", "found").mapInArrow(close, T.StructType([*carried, *fields]))
    return settled.where("_raw is null").select(*carry, *(f.name for f in fields)).unionByName(closed).toDF(*given, *(f.name for f in fields))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind.simpleString()]
