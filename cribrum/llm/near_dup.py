"""MinHash near-dedup: ProbMinHash signatures, banding, verification, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .anchors import Names, mix, word_halves, word_symbols
from .repeats import text_bytes
from .tables import documents, hidden, stage, text_key

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Buckets up to this size are compared pair by pair across classes, larger ones by a prefix filter.
SMALL_BUCKET = 32
#: A text is compared with at most this many others in one part of a join.
PARTNERS = 1024
#: What rounding may take from a bound of the prefix filter.
SLACK = 1e-6


def shingles(raw: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of a text and how often each occurs.

    A text of fewer words is one shingle; a text without words has none.
    """
    words = word_symbols(raw)
    if not len(words):
        return words, np.zeros(0, np.int64)
    return np.unique(Names(word_halves(words)).all(min(size, len(words))), return_counts=True)


def prob_min_hash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures (n, registers) of n weighted sets given as flat arrays.

    Each element has a Poisson process of arrivals whose rate is its weight;
    each arrival falls into a uniformly chosen register, which keeps the element
    that arrived first.  An element ends once its next arrival comes after the
    latest time held by any register of its set.
    """
    first = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(element))
    live = np.arange(len(element))
    turn = 0
    while len(live):
        draw = mix(element[live] + np.uint64((turn + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
        time[live] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        register = (mix(draw) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        slot = owner[live] * registers + register.astype(np.int64)
        now = time[live]
        np.minimum.at(first, slot, now)
        won = first[slot] == now
        held[slot[won]] = element[live[won]]
        latest = first.reshape(n, registers).max(axis=1)
        live = live[now < latest[owner[live]]]
        turn += 1
    return held.reshape(n, registers)


def _band_rows(batches: Iterator[pa.RecordBatch], bands: int, rows: int, chunk: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
            sets = [shingles(data[offsets[i] : offsets[i + 1]])[0] for i in range(at, stop)]
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                sizes = np.array([len(sets[i]) for i in full])
                signature = prob_min_hash(
                    np.repeat(np.arange(len(full)), sizes),
                    np.concatenate([sets[i] for i in full]),
                    # Weight 1 each: registers then agree with the probability of the set similarity that is verified.
                    np.ones(sizes.sum()),
                    len(full),
                    bands * rows,
                ).reshape(len(full), bands, rows)
                key = np.tile(salt, (len(full), 1))
                for r in range(rows):
                    key = mix(key ^ signature[:, :, r])
                node = batch.column("node").take(pa.array(np.repeat(np.array(full) + at, bands)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), node], names=["bucket", "node"])
            at = stop


def _verify_rows(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [text_bytes(batch.column(c)) for c in ("ta", "tb")]
        keep = []
        for i in range(batch.num_rows):
            a, b = (shingles(data[offsets[i] : offsets[i + 1]])[0] for data, offsets in sides)
            if min(len(a), len(b)) < threshold * max(len(a), len(b)):
                keep.append(False)
                continue
            shared = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(shared >= threshold * (len(a) + len(b) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingle_rows(batches: Iterator[pa.RecordBatch], chunk: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        node, comp = batch.column("node").to_numpy(), batch.column("comp").to_numpy()
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
            sets = [shingles(data[offsets[i] : offsets[i + 1]])[0] for i in range(at, stop)]
            sizes = np.array([len(s) for s in sets])
            columns = [np.repeat(node[at:stop], sizes), np.repeat(comp[at:stop], sizes), np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "comp", "size", "element"])
            at = stop


def prefix_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) across classes that can reach the threshold, out of rows node, comp, text.

    An exact prefix filter.  With shingles in one order, rare ones first, a pair
    of similarity t has its first common shingle where t of the larger set and
    2t / (1 + t) of the smaller one are still to come, and t / (1 + t) of both
    sizes together at either place.
    """
    rows = stage(placed.select("node", "comp", "text").mapInArrow(_shingle_rows, "node long, comp long, size long, element long"), "shingles")
    shared = rows.groupBy("element").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "element")
    ranked = rows.join(shared, "element", "left").withColumn("rest", F.col("size") - F.row_number().over(order) + 1)
    ranked = stage(ranked.where((F.col("rest") >= threshold * F.col("size") - SLACK) & F.col("df").isNotNull()), "prefixes")
    of_both = threshold / (1 + threshold)
    x = ranked.where(F.col("rest") >= 2 * of_both * F.col("size") - SLACK).alias("x")
    pairs = x.join(ranked.alias("y"), "element").where(
        (F.col("x.comp") != F.col("y.comp"))
        & (F.struct("x.size", "x.node") < F.struct("y.size", "y.node"))
        & (F.col("x.size") >= threshold * F.col("y.size") - SLACK)
        & (F.least("x.rest", "y.rest") >= of_both * (F.col("x.size") + F.col("y.size")) - SLACK)
    )
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Columns node, comp: the least node of each node's component, for nodes with edges (a, b)."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", narrow=True)
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "comp", narrow=True)
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("via"))
        jump = label.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        new = stage(step.join(jump, "via").select("node", "old", F.least("via", "far").alias("comp")), "comp", narrow=True)
        label = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            return label


def _placed(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows doc_id, key (the text's), comp (the class's name; null for texts without words), as ``near_classes`` links them."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("who")
    nodes = docs.select("doc_id", "text", who, text_key(F.col("text")).alias("node"))
    words = F.col("text").rlike("[^ \\t-\\r]")
    members = stage(nodes.select("doc_id", "who", F.col("node").alias("key"), F.when(words, F.col("node")).alias("node")), "members")
    held = stage(nodes.select("node", "text").mapInArrow(lambda b: _band_rows(b, bands, rows), "bucket long, node binary").distinct(), "buckets")
    full = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = held.join(full, "bucket")
    # From here on, nodes that share a bucket go by whole numbers of their own.
    ids = stage(crowded.groupBy("node").agg(F.sum("n").alias("rank")).withColumn("id", F.monotonically_increasing_id()), "ids")
    crowded = stage(crowded.join(ids, "node").select("bucket", "n", F.col("id").alias("node"), "rank"), "crowded")

    # Each node's text comes from one row; the join's key tells copies apart, so that a large group of them is dealt out.
    chosen = members.groupBy("node").agg(F.min("who").alias("who")).join(ids, "node").select("node", "who", "id")
    texts = stage(nodes.join(chosen, ["node", "who"]).dropDuplicates(["node", "who"]).select(F.col("id").alias("node"), "text"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        # Ends (b) with many partners are dealt out in parts, each with a copy of b's text.
        load = stage(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts")), "load", narrow=True)
        spread = pairs.join(load, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
        of_b = texts.join(load, F.col("node") == F.col("b")).select("b", F.col("text").alias("tb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        one = spread.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        two = one.join(of_b, ["b", "part"])
        return stage(two.select("a", "b", "ta", "tb").mapInArrow(lambda x: _verify_rows(x, threshold), "a long, b long"), "links")

    centre = F.max(F.struct("rank", "node"))["node"]
    leaders = crowded.groupBy("bucket").agg(centre.alias("b"))
    star = stage(
        crowded.join(leaders, "bucket").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared")),
        "star",
        narrow=True,
    )
    best = stage(star.groupBy("a").agg(F.max(F.struct("shared", "b"))["b"].alias("b")), "best", narrow=True)
    links = verified(best)
    tried = best.select("a", "b")
    for turn in range(4):
        comp = connected(links)
        placed = crowded.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_buckets = placed.groupBy("bucket").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("rank", "node")).alias("top")
        ).where("lo <> hi")
        if turn == 0:
            more = star.select("a", "b")
        else:
            left = stage(placed.join(open_buckets, "bucket"), "open")
            if left.isEmpty():
                break
            if turn < 3:
                # The next centre: the most central node outside the first one's class.
                first = left.where("node = top.node").select("bucket", F.col("comp").alias("first"))
                other = left.join(first, "bucket").where("comp <> first").groupBy("bucket").agg(F.max(F.struct("rank", "node", "comp")).alias("next"))
                more = left.join(other, "bucket").where("comp <> next.comp").select(F.col("node").alias("a"), F.col("next.node").alias("b"))
            else:
                # Every pair that is left: pair by pair, or those that the prefix filter lets through.
                small = left.where(F.col("n") <= SMALL_BUCKET).select("bucket", "node", "comp")
                pair = small.alias("x").join(small.alias("y"), "bucket").where("x.comp < y.comp").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
                large = left.where(F.col("n") > SMALL_BUCKET).select("node", "comp").distinct()
                more = pair.union(prefix_pairs(large.join(texts, "node"), threshold))
        of_a = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        of_b = comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        fresh = (
            more.distinct()
            .join(tried, ["a", "b"], "left_anti")
            .join(of_a, "a", "left")
            .join(of_b, "b", "left")
            .where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
            .select("a", "b")
        )
        fresh = stage(fresh, "fresh", narrow=True)
        if fresh.isEmpty():
            continue
        links = links.union(verified(fresh))
        tried = tried.union(fresh)
    comp = connected(links)

    # Classes of several nodes are named by a number, the others by their one node.
    placed = comp.join(ids.select(F.col("id").alias("node"), F.col("node").alias("key")), "node").select(F.col("key").alias("node"), F.col("comp").cast("string").cast("binary").alias("comp"))
    return members.join(placed, "node", "left").select("doc_id", "key", F.coalesce("comp", "node").alias("comp"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, class_id (least doc_id of its class), class_size.

    Documents are linked when the Jaccard similarity of their sets of word
    shingles is at least ``threshold``; classes are what links connect.  Equal
    texts are one node throughout, so copies cost one row each.  Candidates
    share a band of ProbMinHash registers, where each distinct shingle has weight 1
    as in that similarity, and every candidate is verified on the whole texts.  In each bucket
    members are verified against its most central node, the one whose buckets
    are fullest; then, across classes only, against two further centres; and then
    all that share a bucket are compared across classes, pair by pair in buckets of
    up to SMALL_BUCKET nodes and after a prefix filter in larger ones.

    Null, empty and blank texts are in classes of their own; rows that repeat
    share a class, whose class_id ignores nulls and is null where all ids are.
    Texts are read whole, about four megabytes at a time or one text.  Other
    columns are not read; an empty table gives no rows.
    """
    grouped = _placed(docs, threshold, bands, rows)
    classes = grouped.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return grouped.join(classes, "comp", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class: that of least doc_id, of several texts under it the one whose key is least.

    Rows alike in doc_id and text count once; texts under one doc_id that are not
    near copies are different documents and all stay.  Texts without words are no
    copies of each other; documents whose doc_id is null belong to no class here, and
    stay.  Columns besides doc_id and text stay as they are, whatever their names;
    which row's, where rows repeat, is left open.
    """
    table, _ = hidden(docs, ["doc_id", "text"])
    placed = _placed(table.where("doc_id is not null"))
    first = placed.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "key")).alias("one")).select("one.*")
    keep = stage(first.union(placed.where("comp is null").select("doc_id", "key")).distinct(), "kept")
    keyed = table.where("doc_id is not null").withColumn("_key", text_key(F.col("text")))
    chosen = keyed.join(keep.withColumnRenamed("key", "_key"), ["doc_id", "_key"], "left_semi").dropDuplicates(["doc_id", "_key"])
    return chosen.select(*table.columns).union(table.where("doc_id is null")).toDF(*docs.columns)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_classes`` of documents: five words, similarity 0.8; edge cases as there."""
    return near_classes(documents(spark, sf_dir))
