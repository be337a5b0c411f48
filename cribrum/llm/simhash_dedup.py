"""SimHash near-dedup: majority fingerprints of word shingles, BK-trees over shards of fingerprints, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import connected
from .repeats import text_bytes
from .tables import documents, stage

SHINGLE, SEED = 3, 42
#: Fingerprints are linked at this many differing bits or fewer.
RADIUS = 2
BITS = 64
#: Fingerprints up to which a shard becomes one tree; larger shards are cut by further bits, at most so many times.
SHARD, CUTS = 4096, 4
#: Shingles counted at a time, bytes of a text looked at at a time, queries searched at a time.
SHINGLES, PIECE, QUERIES = 1 << 16, 1 << 20, 1 << 14


def word_lists(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased in A-Z, a bounded number of bytes at a time (more only within one word)."""
    at = 0
    while at < len(raw):
        stop = at + piece
        while stop < len(raw) and not (raw[stop] == 32 or 9 <= raw[stop] <= 13):
            stop += 1
        yield raw[at:stop].lower().split()
        at = stop


def shingle_hashes(raw: bytes, size: int = SHINGLE) -> Iterator[list[int]]:
    """XXH64 of every run of ``size`` words (of all words if there are fewer), repeats included, in parts."""
    held: list[bytes] = []
    full = False
    for words in word_lists(raw):
        held += words
        if len(held) < size:
            continue
        full = True
        text = b" ".join(held)
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        yield [xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
        held = held[len(held) - size + 1 :]
    if held and not full:
        yield [xxhash.xxh64_intdigest(b" ".join(held), SEED)]


def fingerprints(raws: list[bytes]) -> np.ndarray:
    """A fingerprint a text: each bit is 1 if it is in over half of its shingles' hashes; 0 for a text without words."""
    ones, total = np.zeros((len(raws), BITS), np.int64), np.zeros(len(raws), np.int64)
    owners: list[int] = []
    sizes: list[int] = []
    hashes: list[int] = []

    def count() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8)).reshape(-1, BITS)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            np.add.at(total, owners, sizes)
        for x in (owners, sizes, hashes):
            x.clear()

    for i, raw in enumerate(raws):
        for part in shingle_hashes(raw):
            owners.append(i)
            sizes.append(len(part))
            hashes.extend(part)
            if len(hashes) >= SHINGLES:
                count()
    count()
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


class Forest:
    """BK-trees, one a group: a node's children are keyed by their Hamming distance to it.

    ``group`` is ascending and ``value`` distinct within a group; the first of each
    group is the root of its tree.  All trees are built, and searched, level by level.
    """

    def __init__(self, group: np.ndarray, value: np.ndarray):
        self.value = value
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1]
        live = np.flatnonzero(~new)
        at = self.root[live]
        keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(live):
            edge = at * (BITS + 1) + self.distance(live, at)
            found, first, place = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(found)
            children.append(live[first])
            at = live[first][place]
            rest = live != at
            live, at = live[rest], at[rest]
        key, child = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.value[a] ^ self.value[b]).astype(np.int64)

    def links(self, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (a < b) in one group whose values differ in at most ``radius`` bits.

        Every value is a query to its own tree; of a node at distance d only edges d - radius to d + radius are followed.
        """
        for lo in range(0, len(self.value), QUERIES):
            query = np.arange(lo, min(lo + QUERIES, len(self.value)))
            node = self.root[query]
            while len(query):
                d = self.distance(query, node)
                near = (d <= radius) & (query < node)
                yield query[near], node[near]
                first = np.searchsorted(self.key, node * (BITS + 1) + np.maximum(d - radius, 0))
                last = np.searchsorted(self.key, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
                n = last - first
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                query, node = np.repeat(query, n), self.child[np.repeat(first, n) + step]


def cuts(mask: int) -> list[int]:
    """``mask`` with one of RADIUS + 1 equal parts of the bits that it lacks: values that agree in ``mask`` and are linked agree in one of these."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    edges = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    wider = [mask | sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:])]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in wider]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("values")
        sizes = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy()
        forest = Forest(np.repeat(np.arange(len(sizes)), sizes), values.view(np.uint64))
        for a, b in forest.links():
            yield pa.RecordBatch.from_arrays([pa.array(values[a]), pa.array(values[b])], names=["a", "b"])


def linked(values: DataFrame, shard: int = SHARD, limit: int = CUTS) -> DataFrame:
    """Rows a, b: pairs of the distinct ``value``s (long) that differ in at most RADIUS bits; a pair may repeat.

    A shard is a mask and what values are under it.  Of RADIUS + 1 parts of the
    bits two linked values share at least one, so shards of these parts hold all
    links.  Shards of more than ``shard`` values are cut by the bits that their mask
    lacks, in the same way; after four cuts a mask lacks at most 14 bits, so that no
    shard can hold more than 2 ** 14 values.  A shard's values and its tree are in
    one row, bounded by that.
    """
    masks = {0: cuts(0)}
    under = F.col("value").bitwiseAND(F.col("mask"))
    rows = values.select("value", F.explode(F.array(*map(F.lit, masks[0]))).alias("mask")).withColumn("under", under)
    links = []
    for turn in range(limit):
        sizes = stage(rows.groupBy("mask", "under").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
        last = turn == limit - 1
        fit = sizes if last else sizes.where(F.col("n") <= shard)
        trees = rows.join(fit, ["mask", "under"]).groupBy("mask", "under").agg(F.collect_list("value").alias("values"))
        links.append(stage(trees.select("values").mapInArrow(_links, "a long, b long"), "links"))
        large = sizes.where(F.col("n") > shard)
        if last or large.isEmpty():
            break
        held = sorted({m for own in masks.values() for m in own})
        masks = {m: cuts(m & (1 << BITS) - 1) for m in held}
        wider: Column = F.create_map(*[x for m in held for x in (F.lit(m), F.array(*map(F.lit, masks[m])))])
        # Two masks may be widened to the same one.
        cut = rows.join(large, ["mask", "under"]).select("value", F.explode(wider[F.col("mask")]).alias("mask")).distinct()
        rows = stage(cut.withColumn("under", under), "cut")
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def simhash_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id reachable over links).

    Texts are read whole, about a megabyte at a time.  Equal fingerprints are one
    node, so copies cost one row each; null, empty and blank texts have
    fingerprint zero, which is linked like any other.  Rows that repeat stay;
    component_id ignores null ids and is null where all of a component are.  Other
    columns are not read; an empty table gives no rows.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data, offsets = text_bytes(part.column("text"))
                found = fingerprints([data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(docs.select("doc_id", "text").mapInArrow(prints, f"doc_id {kind}, value long"), "fingerprints")
    nodes = stage(rows.groupBy("value").agg(F.min("doc_id").alias("least")), "values")
    placed = connected(linked(nodes.select("value"))).withColumnRenamed("node", "value")
    heads = nodes.join(placed, "value").groupBy("comp").agg(F.min("least").alias("head"))
    # Fingerprints without links are components of their own.
    named = nodes.join(placed.join(heads, "comp").select("value", "comp", "head"), "value", "left")
    named = stage(named.select("value", F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("head")).alias("component_id")), "components")
    return rows.join(named, "value").select("doc_id", F.lpad(F.lower(F.hex("value")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``simhash_components`` of documents; edge cases as there."""
    return simhash_components(documents(spark, sf_dir))
