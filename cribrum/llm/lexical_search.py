"""Ranked lexical search: a K2-treap over each shard's grid of terms and documents, searched best-first."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .repeats import text_bytes
from .tables import documents, new_path, stage

TOP = 20
#: A shard of the index ends with the document that reaches so many terms or documents.
SHARD_TERMS, SHARD_DOCS = 2_000_000, 1 << 16
#: Bytes of a text looked at at a time, bytes of items in one pass over the index, states widened at a time.
PIECE, BLOCK, BEAM = 1 << 20, 32 << 20, 128

#: Terms are runs of bytes other than ASCII ones that are no letters or digits; A-Z become a-z.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_ONES = np.array([i.bit_count() for i in range(16)], np.int64)


def term_lists(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, a bounded number of bytes at a time (more only within one term)."""
    clean = raw.translate(_TERM_BYTES)
    at = 0
    while at < len(clean):
        stop = clean.find(b" ", at + piece)
        stop = len(clean) if stop < 0 else stop
        yield clean[at:stop].split()
        at = stop


class Numbers(dict):
    """Numbers terms in the order in which they are first asked for."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _spread(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of each number, moved to the even places."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(keep)
    return x


class Treap:
    """A grid of whole numbers as a quadtree: nodes breadth first, each with the mask of its non-empty quarters and its greatest value.

    The greatest value is kept as the drop from the parent's.  Quarter 2 * r + c is that of row half r and column half c.
    """

    def __init__(self, depth: int, masks: np.ndarray, greatest: np.ndarray):
        self.depth = depth
        # The last entry, which index -1 means, is an empty node.
        self.mask = np.zeros(len(greatest) + 1, np.int64)
        self.mask[: len(masks)] = masks
        self.greatest = np.append(greatest, 0)
        self.first = 1 + np.cumsum(_ONES[self.mask]) - _ONES[self.mask]

    @staticmethod
    def build(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Depth, masks and drops of the non-empty grid; the first drop is the greatest value of all."""
        depth = max(1, int(max(row.max(), column.max())).bit_length())
        code = _spread(row) << np.uint64(1) | _spread(column)
        order = np.argsort(code)
        code, value = code[order], value[order]
        masks, drops = [], []
        for _ in range(depth):
            quarter = np.left_shift(1, (code & np.uint64(3)).astype(np.int64))
            code = code >> np.uint64(2)
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            top = np.maximum.reduceat(value, starts)
            drops.append(np.repeat(top, np.diff(np.append(starts, len(code)))) - value)
            masks.append(np.bitwise_or.reduceat(quarter, starts).astype(np.uint8))
            code, value = code[starts], top
        return depth, np.concatenate(masks[::-1]), np.concatenate([value, *drops[::-1]])

    @staticmethod
    def pack(masks: np.ndarray, drops: np.ndarray) -> bytes:
        """Two masks a byte, then the drops by planes of bytes, compressed."""
        even = np.append(masks, np.zeros(len(masks) % 2, np.uint8))
        planes = drops.astype("<u8").view(np.uint8).reshape(-1, 8).T
        used = max(1, (int(drops.max()).bit_length() + 7) // 8)
        head = np.array([len(masks), len(drops), used], "<i8").tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + (even[::2] | even[1::2] << 4).tobytes() + planes[:used].tobytes())

    @staticmethod
    def unpack(depth: int, raw: bytes) -> Treap:
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        n, nodes, used = (int(x) for x in data[:24].view("<i8"))
        packed = data[24 : 24 + (n + 1) // 2]
        masks = np.stack([packed & 15, packed >> 4], 1).ravel()[:n]
        planes = data[24 + len(packed) :].reshape(used, nodes)
        greatest = np.zeros(nodes, np.int64)
        for i, plane in enumerate(planes):
            greatest |= plane.astype(np.int64) << 8 * i
        # Level by level, a node's value is its parent's less its drop.
        at, stop = 0, 1
        while stop < nodes:
            children = _ONES[masks[at:stop]]
            more = int(children.sum())
            greatest[stop : stop + more] = np.repeat(greatest[at:stop], children) - greatest[stop : stop + more]
            at, stop = stop, stop + more
        return Treap(depth, masks, greatest)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns, and their sums of weighted values over the rows, with all that reach the k-th best, ``floor`` and 1.

        A state is a range of columns with the node of each row that covers it; the
        weighted greatest values of its nodes bound the sums in it.  The states of
        the highest bounds are halved first, until no bound reaches the k-th sum.
        """
        floor = max(1, floor)
        level, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
        node = np.zeros((1, len(rows)), np.int64)
        bound = np.array([int(self.greatest[0] * weights.sum())])
        held_column, held_sum = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            if len(bound) > BEAM:
                order = np.argpartition(-bound, BEAM)
                take, rest = order[:BEAM], order[BEAM:]
                rest = rest[bound[rest] >= floor]
            else:
                take, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            now = node[take]
            half = rows >> (self.depth - 1 - level[take])[:, None] & 1
            mask, first = self.mask[now], self.first[now]
            parts = [(level[rest], column[rest], node[rest], bound[rest])]
            for c in (0, 1):
                quarter = 2 * half + c
                child = np.where(mask >> quarter & 1, first + _ONES[mask & (1 << quarter) - 1], -1)
                most = self.greatest[child] @ weights
                keep = most >= floor
                parts.append((level[take][keep] + 1, 2 * column[take][keep] + c, child[keep], most[keep]))
            level, column, node, bound = (np.concatenate(x) for x in zip(*parts))
            done = level == self.depth
            if done.any():
                held_column, held_sum = np.append(held_column, column[done]), np.append(held_sum, bound[done])
                if len(held_sum) >= k:
                    floor = max(floor, int(np.partition(held_sum, -k)[-k]))
                    reach = held_sum >= floor
                    held_column, held_sum = held_column[reach], held_sum[reach]
                go_on = ~done & (bound >= floor)
                level, column, node, bound = level[go_on], column[go_on], node[go_on], bound[go_on]
        return held_column, held_sum


def term_counts(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with at least one term, and of all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = total = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in zip(offsets, offsets[1:]):
                n = sum(map(len, term_lists(data[a:b].tobytes())))
                some, total = some + (n > 0), total + n
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], names=["some", "total"])

    found = docs.select("text").mapInArrow(run, "some long, total long").agg(F.sum("some"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def build_index(docs: DataFrame, some: int, total: int, path: str | None = None, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The index, written to ``path`` (else into the shared folder): a row a shard of documents.

    doc_ids (by column), terms (sorted, one a line; by row), df (documents of the
    shard that hold the term), depth and treap (compressed).  A cell holds the
    impact of a term in a document, which depends on the corpus only by ``some``
    and ``total``, the counts of ``term_counts``.  Columns go by document length, so that
    neighbours have like impacts.  Every document with a term is in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shard(ids: list, lengths: list[int], numbers: Numbers, parts: list[np.ndarray]) -> pa.RecordBatch:
        terms = sorted(numbers)
        row_of = np.empty(len(terms), np.int64)
        row_of[[numbers[t] for t in terms]] = np.arange(len(terms))
        n = np.array(lengths, np.int64)
        by_length = np.argsort(n, kind="stable")
        column_of = np.empty(len(n), np.int64)
        column_of[by_length] = np.arange(len(n))
        cell, tf = np.unique(np.repeat(column_of, n) << 32 | row_of[np.concatenate(parts)], return_counts=True)
        column, row = cell >> 32, cell & (1 << 32) - 1
        norm = 100 - 25 + 25 * n[by_length] * some // total
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * norm[column])
        depth, masks, drops = Treap.build(row, column, impact)
        id_list = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids).take(pa.array(by_length)))
        df = np.bincount(row, minlength=len(terms))
        return pa.RecordBatch.from_arrays(
            [id_list, pa.array([b"\n".join(terms)]), pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([depth], pa.int32()), pa.array([Treap.pack(masks, drops)])],
            names=["doc_ids", "terms", "df", "depth", "treap"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, numbers, parts, held = [], [], Numbers(), [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            of = batch.column("doc_id")
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                n = 0
                for terms in term_lists(data[a:b].tobytes()):
                    parts.append(np.fromiter(map(numbers.__getitem__, terms), np.int32, len(terms)))
                    n += len(terms)
                if n:
                    ids.append(of.slice(i, 1))
                    lengths.append(n)
                    held += n
                if held >= shard_terms or len(ids) >= SHARD_DOCS:
                    yield shard(ids, lengths, numbers, parts)
                    ids, lengths, numbers, parts, held = [], [], Numbers(), [], 0
        if ids:
            yield shard(ids, lengths, numbers, parts)

    spark = docs.sparkSession
    path = path or new_path(spark, "treaps")
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_ids array<{kind}>, terms binary, df array<long>, depth int, treap binary")
    # Small row groups: a reader holds one of them at a time.
    rows.write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def search(index: DataFrame, items: DataFrame, some: int, k: int = TOP) -> DataFrame:
    """Per item its ``k`` best documents: item_id, rank, doc_id, score; ``some`` as for ``build_index``.

    Items go to the index in blocks of bounded bytes.  Each task keeps the best of
    its shards for every item and starts the next shard from the score they have
    reached; Spark then takes the best over all tasks.
    """
    asked = stage(items.select("item_id", "text").distinct().where("text is not null").withColumn("slot", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    blocks = -(-size // BLOCK)
    best = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("slot"), F.lit(blocks)) == block).select("slot", "text").collect()
        counts = {r["slot"]: Counter(t for part in term_lists(r["text"].encode()) for t in part) for r in rows}
        wanted = set().union(*counts.values())

        def held(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for terms, df in zip(batch.column("terms"), batch.column("df")):
                    found = [(t, i) for i, t in enumerate(terms.as_py().split(b"\n")) if t in wanted]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t for t, _ in found], pa.binary()), df.values.take(pa.array([i for _, i in found], pa.int64()))], names=["term", "df"]
                    )

        df = dict(index.select("terms", "df").mapInArrow(held, "term binary, df long").groupBy("term").agg(F.sum("df")).collect())
        weight = {bytes(t): math.floor(1000 * math.log((2 * some + 2) / (2 * n + 1))) for t, n in df.items()}
        queries = {slot: {t: n * weight[t] for t, n in own.items() if weight.get(t)} for slot, own in counts.items()}

        def run(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            leads: dict[int, list[tuple]] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    row_of = {t: r for r, t in enumerate(batch.column("terms")[i].as_py().split(b"\n"))}
                    ids = batch.column("doc_ids")[i].values
                    treap = Treap.unpack(batch.column("depth")[i].as_py(), batch.column("treap")[i].as_py())
                    for slot, terms in queries.items():
                        here = [(row_of[t], w) for t, w in terms.items() if t in row_of]
                        if not here:
                            continue
                        lead = leads.get(slot, [])
                        rows, weights = (np.array(x, np.int64) for x in zip(*here))
                        column, score = treap.best(rows, weights, k, -lead[-1][0] if len(lead) >= k else 0)
                        names = ids.take(pa.array(column)).to_pylist()
                        new = [(-s, d is None, d) for s, d in zip(score.tolist(), names)]
                        leads[slot] = sorted(lead + new, key=lambda x: x if x[2] is not None else x[:2])[:k]
            rows = [(slot, d, -s) for slot, lead in leads.items() for s, _, d in lead]
            yield pa.RecordBatch.from_pylist([dict(zip(("slot", "doc_id", "score"), r)) for r in rows], schema=pa.schema([("slot", pa.int64()), ("doc_id", batch_type), ("score", pa.int64())]))

        batch_type = _arrow(kind)
        best.append(index.select("doc_ids", "terms", "depth", "treap").mapInArrow(run, f"slot long, doc_id {kind}, score long"))
    if not best:
        return asked.select("item_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("score")).limit(0)
    found = best[0]
    for more in best[1:]:
        found = found.union(more)
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
    return ranked.join(asked.select("slot", "item_id"), "slot").select("item_id", "rank", "doc_id", "score")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Per item its ``k`` highest-scoring documents with a score above 0: item_id, rank, doc_id, score.

    Texts are read whole, about a megabyte at a time.  Null, empty and term-less
    texts are in no ranking and don't count among the documents; items without
    known terms give no rows.  Equal scores go by ascending doc_id, null last; rows
    that repeat a doc_id are documents of their own.  Items alike in item_id and
    text count once; those alike in item_id only are ranked each by itself.  Other
    columns are not read; an empty table on either side gives no rows.
    """
    some, total = term_counts(docs)
    return search(build_index(docs, some, total), items, some, k)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rank_documents`` of documents for each benchmark item; edge cases as there."""
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with d as materialized (select doc_id, {_TERMS} as w from documents),
s as (select count(*)::bigint as n_docs, sum(len(w))::bigint as n_terms from d where len(w) > 0),
t as materialized (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, len(w)::bigint as n, unnest(w) as term from d) group by all),
f as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from t, s group by term, n_docs),
q as (select item_id, unnest({_TERMS}) as term from benchmark),
p as (select doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) as score from t join f using (term), s where term in (select term from q)),
r as (select item_id, doc_id, sum(score)::bigint as score from q join p using (term) group by all having sum(score) > 0)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from r) where rank <= {TOP}
"""
