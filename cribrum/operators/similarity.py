"""Set similarity and nearest neighbours without comparing everything with everything."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import known_shingles, shingles, tanimoto_packed
from .lineage import cut, few
from .ranking import running_totals
from .replicates import with_quantiles

#: Rows up to which one side of a join is broadcast.
BROADCAST_ROWS = 500_000
#: Different n-grams of references up to which they go to the tasks, which look for them in the texts.
KNOWN_SHINGLES = 100_000
#: Elements of sets that meet in a bucket, about; an element with more sets than that brings all of them.
BUCKET = 1 << 19
#: Classes of elements in a block of rows that meets another, and of pairs that are held at a time, about.
MEETING = 1 << 20
#: Rows of which all pairs may be asked for.
SMALL_SET = 10_000


def shared_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (l, r, sim) of all pairs of sets that share an element; left: l, items; right: r, items."""
    a = left.select("l", F.size("items").alias("nl"), F.explode("items").alias("item"))
    b = right.select("r", F.size("items").alias("nr"), F.explode("items").alias("item"))
    return _counted(a, b)


def _counted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (l, r, sim) of elements: l, nl, item and r, nr, item."""
    # A small side goes to the other, which then needs no shuffle of its elements.
    b = F.broadcast(b) if few(b, BROADCAST_ROWS) else b
    shared = a.join(b, "item").groupBy("l", "r", "nl", "nr").agg(F.count(F.lit(1)).alias("n"))
    return shared.select("l", "r", (F.col("n") / (F.col("nl") + F.col("nr") - F.col("n"))).alias("sim"))


def shared_shingles(texts: DataFrame, references: DataFrame, size: int = 3) -> DataFrame:
    """``shared_counts`` of the word n-grams of texts; texts: l, text; references: r, text.

    If the references have few different n-grams, those of a text are counted and
    looked up in one pass over it, and only what is found becomes rows.
    """
    right = references.select("r", shingles(F.col("text"), "word", size).alias("items"))
    b = cut(right.select("r", F.size("items").alias("nr"), F.explode("items").alias("item")))
    known = b.select("item").distinct()
    if few(known, KNOWN_SHINGLES):
        found = texts.select("l", known_shingles(F.col("text"), {r[0] for r in known.collect()}, size).alias("f"))
        a = found.select("l", F.col("f.n").cast("int").alias("nl"), F.explode("f.held").alias("item"))
    else:
        left = texts.select("l", shingles(F.col("text"), "word", size).alias("items"))
        a = left.select("l", F.size("items").alias("nl"), F.explode("items").alias("item"))
    return _counted(a, b)


def nearest_reference(df: DataFrame, key: str, items: str, references: DataFrame, ref_key: str, ref_items: str) -> DataFrame:
    """Per row: its most similar reference (the least key among equals) and the similarity; 0 and null if nothing is shared."""
    pairs = shared_counts(df.select(F.col(key).alias("l"), F.col(items).alias("items")), references.select(F.col(ref_key).alias("r"), F.col(ref_items).alias("items")))
    best = pairs.groupBy("l").agg(F.min(F.struct((-F.col("sim")).alias("s"), "r")).alias("b"))
    return df.join(best.withColumnRenamed("l", key), key, "left").select(*df.columns, F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("max_sim"), F.col("b.r").alias("nearest"))


def _hashed_sets(df: DataFrame, key: str, items: str, *others: str) -> DataFrame:
    """Rows (k, n, s, h, g) of sets with elements: elements are stood for by 64-bit hashes (long ones by themselves), the sets by two of them; empty sets and those without a key take no part.

    Nothing is written: sets are several times as large as their texts, so they are made again where they are asked for.
    """
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} must be a whole number")
    elements = F.col(items) if dict(df.dtypes)[items] == "array<bigint>" else F.transform(items, lambda x: F.xxhash64(x))
    sets = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.array_distinct(elements).alias("s"), *others).where(F.size("s") > 0)
    return sets.select("k", *others, F.size("s").alias("n"), "s", F.xxhash64(F.sort_array("s")).alias("h"), F.xxhash64(F.lit(1), F.sort_array("s")).alias("g"))


def _equal_sets(df: DataFrame, key: str, items: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without duplicates among sets: (k, s); the sizes of sets: (k, n); and the members of each set: (k, rep, size)."""
    hashed = _hashed_sets(df, key, items)
    named = cut(hashed.select("k", "n", "h", "g"))
    same = named.groupBy("h", "g").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("size"))
    members = cut(named.select("k", "h", "g").join(same, ["h", "g"]).select("k", "rep", "size"))
    copies = members.where("k <> rep").select("k")
    sets = hashed.join(F.broadcast(copies) if few(copies, BROADCAST_ROWS) else copies, "k", "left_anti").select("k", "n", "s")
    if members.groupBy("k").count().where("count > 1").isEmpty():
        return sets.select("k", "s"), named.select("k", "n"), members
    sets = cut(sets.dropDuplicates(["k"]))
    return sets.select("k", "s"), sets.select("k", "n"), members


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each number (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SEEDS = 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A


def _bytes_apart(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, the second ones and so on: what is alike lies together, and is compressed."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _bytes_together(parts: list[bytes]) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel() for x in parts]


def _in_buckets(buckets: int):
    """Elements (k, s, fold) as rows b, fold, k, e: the elements of some sets of a fold in a bucket of hashes, and the differences of their sets' keys from one to the next."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("s")
            e, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            k = np.repeat(batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64), n)
            # Mixed, elements are as different as before, and those of a bucket begin alike.
            e = _mixed(e, 0)
            folds, fold = np.unique(batch.column("fold").to_numpy(zero_copy_only=False), return_inverse=True)
            b = (((e >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64) * len(folds) + np.repeat(fold, n)
            order = np.argsort(b.astype(np.uint16) if buckets * len(folds) <= 1 << 16 else b, kind="stable")
            e, k, sizes = e[order], k[order], np.bincount(b)
            ends, used = np.cumsum(sizes), np.flatnonzero(sizes)
            parts = [(x, slice(ends[x] - sizes[x], ends[x])) for x in used.tolist()]
            for lo in range(0, len(parts), 256):
                some = parts[lo : lo + 256]
                with np.errstate(over="ignore"):
                    keys = [_bytes_apart(np.diff(k[at], prepend=np.int64(0))) for _, at in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x // len(folds) for x, _ in some], pa.int32()), pa.array([int(folds[x % len(folds)]) for x, _ in some], pa.int64()), pa.array(keys, pa.binary()), pa.array([_bytes_apart(e[at]) for _, at in some], pa.binary())],
                    names=["b", "fold", "k", "e"],
                )

    return pack


def _met_in_bucket(bucket: pa.Table, across: bool) -> pa.Table:
    """Rows k, c, f, w of the elements of a bucket that two sets (of different folds, if ``across``) have at least."""
    with np.errstate(over="ignore"):
        k = np.concatenate([np.cumsum(x) for x in _bytes_together(bucket.column("k").to_pylist())])
    parts = _bytes_together(bucket.column("e").to_pylist())
    e, fold = np.concatenate(parts), np.repeat(bucket.column("fold").to_numpy(), [len(x) for x in parts])
    order = np.argsort(e, kind="stable")
    e, k, fold = e[order], k[order], fold[order]
    starts = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
    f = np.diff(np.append(starts, len(e)))
    meets = np.minimum.reduceat(fold, starts) != np.maximum.reduceat(fold, starts) if across else f > 1
    k, f = k[np.repeat(meets, f)], f[meets]
    if not len(k):
        return pa.table({"k": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "f": pa.array([], pa.int64()), "w": pa.array([], pa.int64())})
    starts = np.cumsum(f) - f
    h, g = (np.bitwise_xor.reduceat(_mixed(k, seed), starts) for seed in _SEEDS)
    c, f = (np.repeat(x, f) for x in (_mixed(_mixed(_mixed(f, _SEEDS[0]) ^ h, _SEEDS[1]) ^ g, _SEEDS[0]).view(np.int64), f))
    order = np.lexsort((c, k))
    k, c, f = k[order], c[order], f[order]
    starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
    return pa.table({"k": k[starts], "c": c[starts], "f": f[starts], "w": np.diff(np.append(starts, len(k)))})


def _shared_elements(sets: DataFrame, elements: int | None = None, fold: str | None = None) -> DataFrame:
    """Rows (k, c, f, w): the set k has w elements of class c, which are those that the same f sets have, two at least; dealt by k.  With ``fold`` only elements that sets of different folds have.

    Elements of one class are in one set if they are in the other, so they count
    together: a passage that many sets have, or what near copies have in common, is
    one row a set.  Most elements are in one set only; they are counted where they
    meet and go no further.  For that they go packed, in buckets by their hashes;
    ``elements`` tells how many there are in all.
    """
    if elements is None:
        elements = sets.agg(F.sum(F.size("s"))).first()[0]
    buckets = max(4 * sets.sparkSession.sparkContext.defaultParallelism, -(-(elements or 0) // BUCKET))
    of_fold = F.xxhash64(fold) if fold else F.lit(0).cast("long")
    packed = sets.select(F.col("k").cast("long").alias("k"), "s", of_fold.alias("fold")).mapInArrow(_in_buckets(buckets), "b int, fold long, k binary, e binary")
    across = fold is not None
    shared = packed.groupBy("b").applyInArrow(lambda bucket: _met_in_bucket(bucket, across), "k long, c long, f long, w long").repartition("k")
    return shared.groupBy("k", "c", "f").agg(F.sum("w").alias("w"))


def _similar_sets(sets: DataFrame, sizes: DataFrame, tenths: int) -> DataFrame:
    """Pairs (i, j, sim), i < j, of different sets (k, s) of sizes (k, n) with similarity of at least ``tenths`` / 10, exactly.

    Classes of elements are ordered by rarity; two such sets share one that begins
    among their rarest n - ceil(t n) + 1 elements, and differ in size by the factor
    t at most.  What they share beyond these prefixes is less than ceil(t n) of the
    larger one, so pairs whose prefixes have too little in common go before any set
    is sent; the others are compared in full, in whole numbers.
    """
    of_set = Window.partitionBy("k")
    earlier = of_set.orderBy("f", "c").rowsBetween(Window.unboundedPreceding, -1)
    # Elements of one set only come first and pair with nothing.
    before = F.col("n") - F.sum("w").over(of_set) + F.coalesce(F.sum("w").over(earlier), F.lit(0))
    rows = cut(_shared_elements(sets, sizes.agg(F.sum("n")).first()[0]).join(sizes, "k").select("k", "n", "c", "w", before.alias("p")))
    prefix = rows.where(F.col("p") <= F.col("n") - F.ceil(F.lit(tenths) * F.col("n") / 10))
    a, b = prefix.select("c", "w", F.col("k").alias("i"), F.col("n").alias("ni"), F.col("p").alias("pi")), prefix.select("c", F.col("k").alias("j"), F.col("n").alias("nj"), F.col("p").alias("pj"))

    def enough(shared: Column) -> Column:
        return shared * (10 + tenths) >= tenths * (F.col("ni") + F.col("nj"))

    sized = F.least("ni", "nj") * 10 >= F.greatest("ni", "nj") * tenths
    at_most = F.least("pi", "pj") + F.least(F.col("ni") - F.col("pi"), F.col("nj") - F.col("pj"))
    met = a.join(b, "c").where((F.col("i") < F.col("j")) & sized & enough(at_most)).groupBy("i", "j", "ni", "nj").agg(F.sum("w").alias("m"))
    near = met.where(enough(F.col("m") + F.ceil(F.lit(tenths) * F.greatest("ni", "nj") / 10) - 1))
    # A class of w elements is a name for each bit of w, with the bit's place in its last five.
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda x: F.call_function("shiftright", F.col("w"), x).bitwiseAND(F.lit(1)) == 1))
    names = rows.select("k", "c", bit.alias("bit")).groupBy("k").agg(F.collect_list(F.shiftleft(F.xxhash64("c", "bit"), 5).bitwiseOR(F.col("bit").cast("long"))).alias("s"))
    full = near.join(names.select(F.col("k").alias("i"), F.col("s").alias("a")), "i").join(names.select(F.col("k").alias("j"), F.col("s").alias("b")), "j")
    shared = F.aggregate(F.array_intersect("a", "b"), F.lit(0).cast("long"), lambda t, x: t + F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(31)).cast("int")))
    counted = full.select("i", "j", "ni", "nj", shared.alias("c"))
    return counted.where(enough(F.col("c"))).select("i", "j", (F.col("c") / (F.col("ni") + F.col("nj") - F.col("c"))).alias("sim"))


def nearest_across(df: DataFrame, key: str, items: str, fold: str, asked: Column, k: int, per_fold: bool) -> DataFrame:
    """Rows (fold, m, times), with ``other`` if asked for: m is the mean similarity of a row that is asked for to its k most similar rows of all other folds (of each other fold).

    Only what rows share across folds with one asked for counts.  Rows of a fold with
    the same shared classes are as similar to any row as their size says, so of each
    such kind the k smallest are enough; equal rows that ask are one, ``times`` over.
    Time may grow with the square of the rows that share something, memory and disk do not.
    Rows without a fold, or that share nothing, take no part.
    """
    folds = df.select(F.col(key).alias("k"), F.col(fold).alias("fold"), asked.alias("asked")).where("fold is not null")
    sets = _hashed_sets(df.where(F.col(fold).isNotNull()), key, items, fold)
    sizes = cut(sets.select("k", "n"))
    rows = cut(_shared_elements(sets, sizes.agg(F.sum("n")).first()[0], fold).join(sizes, "k").join(folds, "k").select("k", "n", "fold", "asked", "c", "w"))
    useful = rows.groupBy("c").agg(F.bool_or("asked").alias("asked"), F.min("fold").alias("low"), F.max("fold").alias("high")).where("asked and low <> high").select("c")
    kinds = rows.join(useful, "c").groupBy("k", "n", "fold", "asked").agg(F.sort_array(F.collect_list(F.struct("c", "w"))).alias("s"))
    kinds = cut(kinds.withColumns({"h": F.xxhash64("s"), "g": F.xxhash64(F.lit(1), "s")}))
    smallest = Window.partitionBy("fold", "h", "g").orderBy("n", "k")
    others = cut(kinds.withColumn("rn", F.row_number().over(smallest)).where(F.col("rn") <= k).select(F.col("k").alias("j"), F.col("n").alias("nj"), F.col("fold").alias("other"), "s.c"))
    asking = kinds.where("asked").groupBy("fold", "h", "g", "n").agg(F.min_by(F.struct("k", "s"), "k").alias("one"), F.count(F.lit(1)).alias("times"))
    asking = cut(asking.select("fold", "n", "times", F.col("one.k").alias("i"), "one.s.c", F.col("one.s.w").alias("w")))
    # Blocks of both sides meet, each with each; pairs are made and forgotten there.
    left, right = (-(-(x.agg(F.sum(F.size("c"))).first()[0] or 1) // MEETING) for x in (asking, others))
    left = max(left, -(-asking.sparkSession.sparkContext.defaultParallelism // right))

    def lot(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    left_rows = asking.withColumns({"a": lot("i", left), "b": F.explode(F.sequence(F.lit(0), F.lit(right - 1)))})
    right_rows = others.withColumns({"a": F.explode(F.sequence(F.lit(0), F.lit(left - 1))), "b": lot("j", right)})
    kind, keys = kinds.schema["fold"].dataType.simpleString(), ["other"] if per_fold else []
    schema = ", ".join(["i long", f"fold {kind}", "times long", *[f"{c} {kind}" for c in keys], "sims array<double>"])
    best = left_rows.groupBy("a", "b").cogroup(right_rows.groupBy("a", "b")).applyInArrow(_nearest_in(k, per_fold), schema)
    merged = best.groupBy("i", "fold", *keys, "times").agg(F.slice(F.sort_array(F.flatten(F.collect_list("sims")), False), 1, k).alias("s"))
    return cut(merged.select("fold", *keys, (F.aggregate("s", F.lit(0.0), lambda t, x: t + x) / F.size("s")).alias("m"), "times"))


def _nearest_in(k: int, per_fold: bool):
    """Of a block of asking rows and a block of others: the k highest similarities of each asking row to rows of other folds (of each other fold), as rows i, fold, times, (other,) sims."""

    def lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
        held = table.column(column).combine_chunks()
        return held.flatten().to_numpy(zero_copy_only=False), held.value_lengths().to_numpy(zero_copy_only=False)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        folds = pa.chunked_array([*left.column("fold").chunks, *right.column("other").chunks], left.schema.field("fold").type).combine_chunks().dictionary_encode()
        codes = folds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        fold, other = codes[: left.num_rows], codes[left.num_rows :]
        if left.num_rows and right.num_rows:
            (c, size), w, (rc, rsize) = lists(left, "c"), lists(left, "w")[0], lists(right, "c")
            n, nj = left.column("n").to_numpy(), right.column("nj").to_numpy()
            order = np.argsort(rc, kind="stable")
            rc, holder = rc[order], np.repeat(np.arange(len(rsize)), rsize)[order]
            at, row = np.searchsorted(rc, c), np.repeat(np.arange(len(size)), size)
            times = np.searchsorted(rc, c, side="right") - at
            # As many asking rows at a time as meet about MEETING classes.
            reach = np.cumsum(np.bincount(row, times, len(size))).astype(np.int64)
            ends = np.cumsum(size)
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + MEETING, side="right")))
                some = slice(ends[lo] - size[lo], ends[hi - 1])
                t = times[some]
                j = holder[np.repeat(at[some] - np.cumsum(t) + t, t) + np.arange(t.sum())]
                i, both = np.repeat(row[some], t), np.repeat(w[some], t)
                apart = fold[i] != other[j]
                pair, both = i[apart] * len(rsize) + j[apart], both[apart]
                if len(pair):
                    order = np.argsort(pair, kind="stable")
                    pair, both = pair[order], both[order]
                    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                    both, (i, j) = np.add.reduceat(both, starts), np.divmod(pair[starts], len(rsize))
                    sim, to = both / (n[i] + nj[j] - both), other[j] if per_fold else np.zeros(len(i), np.int64)
                    order = np.lexsort((-sim, to, i))
                    i, to, sim = i[order], to[order], sim[order]
                    starts = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (to[1:] != to[:-1])))
                    place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
                    found.append((i[place < k], to[place < k], sim[place < k]))
                lo = hi
        i, to, sim = (np.concatenate(x) for x in zip(*found))
        starts = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (to[1:] != to[:-1])))[: len(i)]
        out = left.select(["i", "fold", "times"]).take(pa.array(i[starts]))
        if per_fold:
            out = out.append_column("other", folds.dictionary.take(pa.array(to[starts])))
        return out.append_column("sims", pa.ListArray.from_arrays(pa.array(np.append(starts, len(i)), pa.int32()), pa.array(sim)))

    return meet


def similarity_self_join(df: DataFrame, key: str, items: str, tenths: int) -> DataFrame:
    """Pairs (i, j, sim), i < j, of rows whose sets have a similarity of at least ``tenths`` / 10, exactly.

    Sets are compared once, however many rows have them; ``similarity_links``
    gives the result without expanding these rows into pairs.
    """
    sets, n, members = _equal_sets(df, key, items)
    same = members.where("size > 1 and k = rep").select(F.col("rep").alias("i"), F.col("rep").alias("j"), F.lit(1.0).alias("sim"))
    pairs = cut(_similar_sets(sets, n, tenths)).unionByName(same)
    left, right = members.select(F.col("rep").alias("i"), F.col("k").alias("ki")), members.select(F.col("rep").alias("j"), F.col("k").alias("kj"))
    wide = pairs.join(left, "i").join(right, "j").where("i <> j or ki < kj")
    return wide.select(F.least("ki", "kj").alias("i"), F.greatest("ki", "kj").alias("j"), "sim")


def similarity_links(df: DataFrame, key: str, items: str, tenths: int) -> DataFrame:
    """Per row: key, class_id (the least key of its equal sets) and n_links, the rows with a similarity of at least ``tenths`` / 10."""
    sets, n, members = _equal_sets(df, key, items)
    pairs = cut(_similar_sets(sets, n, tenths))
    sizes = members.where("k = rep").select("k", "size").distinct()
    both = pairs.select(F.col("i").alias("rep"), F.col("j").alias("k")).unionByName(pairs.select(F.col("j").alias("rep"), F.col("i").alias("k")))
    links = both.join(sizes, "k").groupBy("rep").agg(F.sum("size").alias("others"))
    counted = members.join(links, "rep", "left").select("k", "rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return df.select(F.col(key).alias("k")).join(counted, "k", "left").select(F.col("k").alias(key), F.coalesce("rep", "k").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def weighted_pairs(df: DataFrame, key: str, items: str, tenths: int, features: list[str]) -> DataFrame:
    """Similar pairs of rows as (sim, <f>_i, <f>_j, n): n pairs have this similarity and these features on either side.

    Sets are compared once, and each class of equal sets has a histogram of its
    rows' features: a pair of classes gives a row for each two entries of the
    histograms, and a class gives its own pairs as products of counts.  So a
    million copies with equal features are one row, not 10**12.  The two sides of
    a pair are in no order.
    """
    sets, n, members = _equal_sets(df, key, items)
    of_row = df.select(F.col(key).alias("k"), *features)
    counts = cut(members.select("k", "rep").join(of_row, "k").groupBy("rep", *features).agg(F.count(F.lit(1)).alias("c")))

    def side(end: str) -> DataFrame:
        return counts.select(F.col("rep").alias(end), *[F.col(f).alias(f"{f}_{end}") for f in features], F.col("c").alias(f"c_{end}"))

    across = _similar_sets(sets, n, tenths).join(side("i"), "i").join(side("j"), "j").withColumn("n", F.col("c_i") * F.col("c_j"))
    own = side("i").join(side("j"), F.col("i") == F.col("j"))
    # A histogram's entries against themselves, and against later ones.
    left, right = (F.struct(*[F.col(f"{f}_{end}") for f in features]) for end in "ij")
    within = own.where(left <= right).withColumn("n", F.when(left == right, F.col("c_i") * (F.col("c_i") - 1) / 2).otherwise(F.col("c_i") * F.col("c_j")).cast("long"))
    names = [f"{f}_{end}" for f in features for end in "ij"]
    both = across.select("sim", *names, "n").unionByName(within.where("n > 0").select(F.lit(1.0).alias("sim"), *names, "n"))
    # Statistics read these rows several times.
    return cut(both.groupBy("sim", *names).agg(F.sum("n").alias("n")))


def novel(df: DataFrame, key: str, items: str, references: DataFrame, ref_key: str, ref_items: str, most: float) -> DataFrame:
    """Rows whose nearest reference is at most ``most`` similar, annotated with it."""
    return nearest_reference(df, key, items, references, ref_key, ref_items).where(F.col("max_sim") <= most)


def all_pairs(df: DataFrame, key: str, words: str) -> DataFrame:
    """Similarity of all pairs i < j of a stated set of up to SMALL_SET packed fingerprints; more are an error."""
    if not few(df, SMALL_SET):
        raise ValueError(f"all pairs of more than {SMALL_SET} rows")
    small = F.broadcast(df.select(F.col(key).alias("j"), F.col(words).alias("b")))
    return df.select(F.col(key).alias("i"), F.col(words).alias("a")).join(small, F.col("i") < F.col("j")).select("i", "j", tanimoto_packed(F.col("a"), F.col("b")).alias("sim"))


def _blocks(df: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """Rows packed into matrices: block, ids, n, data (float64, row-major)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                matrix = np.array(part.column("v").to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("k").to_pylist()]), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "data"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).where("v is not null").mapInArrow(pack, "ids array<long>, data binary")


def nearest_rows(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """Rows (query, neighbour, sim, place): the k rows of highest cosine to each query, itself excluded, exactly.

    Queries and rows meet as blocks of ``block`` vectors; each meeting is one
    matrix product that keeps k rows a query, merged by rank afterwards.  A meeting
    is a group of its own, so that Python holds one at a time.
    """

    def score(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(scored(group.to_batches()))

    def scored(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, ids = (np.array(batch.column(c)[row].as_py()) for c in ("q_ids", "ids"))
                q, x = (np.frombuffer(batch.column(c)[row].as_py()).reshape(n, -1) for c, n in (("q_data", len(q_ids)), ("data", len(ids))))
                q, x = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30) for m in (q, x))
                sim = q @ x.T
                sim[q_ids[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(sim, top, 1)
                keep = np.isfinite(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, keep.sum(axis=1))), pa.array(ids[top][keep]), pa.array(value[keep])], names=["query", "neighbour", "sim"]
                )

    asked = _blocks(queries, key, vector, block).toDF("q_ids", "q_data")
    both = asked.crossJoin(_blocks(df, key, vector, block))  # the query set against all rows, in blocks
    found = both.groupBy(F.get("q_ids", F.lit(0)).alias("_q"), F.get("ids", F.lit(0)).alias("_b")).applyInArrow(score, "query long, neighbour long, sim double")
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "neighbour")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def pair_bins(pairs: DataFrame, sim: str, difference: str, weight: str, bins: int = 20, least: int = 10) -> DataFrame:
    """Per similarity bin: n, median and quartiles of the difference where there are ``least`` pairs; each row counts ``weight`` times."""
    # A product, as a quotient by the width puts 0.35 and others below the bin that they begin.
    binned = pairs.withColumn("bin", F.least(F.floor(F.col(sim) * bins), F.lit(bins - 1)).cast("int"))
    sums = binned.groupBy("bin").agg(F.sum(weight).alias("n"))
    stats = with_quantiles(sums, ["bin"], binned, difference, {"median": 0.5, "q25": 0.25, "q75": 0.75}, weight)
    return stats.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("median", "q25", "q75")})


def _times(condition: Column, weight: str) -> Column:
    return F.sum(F.when(condition, F.col(weight)).otherwise(0))


def cliff_rate(pairs: DataFrame, sim: str, difference: str, similar: float, steep: float, weight: str) -> DataFrame:
    close, cliff = F.col(sim) >= similar, F.col(difference) >= steep
    return pairs.agg(_times(close, weight).alias("n_similar"), _times(close & cliff, weight).alias("n_cliffs")).withColumn("rate", F.when(F.col("n_similar") > 0, F.col("n_cliffs") / F.col("n_similar")))


def stratified_cliffs(pairs: DataFrame, group_i: str, group_j: str, sim: str, difference: str, similar: list[float], steep: float, weight: str) -> DataFrame:
    """By pair category (same, cross, unassigned) and similarity threshold: n, median, mean, deviation, cliffs, rate, median similarity."""
    keys = ["category", "threshold"]
    category = F.when(F.col(group_i).isNull() | F.col(group_j).isNull(), "unassigned").when(F.col(group_i) == F.col(group_j), "same").otherwise("cross")
    rows = pairs.withColumn("category", category).withColumn("threshold", F.explode(F.array(*map(F.lit, similar)))).where(F.col(sim) >= F.col("threshold"))
    n, x = F.sum(weight), F.col(difference)
    sums = rows.groupBy(*keys).agg(n.alias("n"), (F.sum(x * F.col(weight)) / n).alias("mean"), _times(x >= steep, weight).alias("n_cliffs"))
    centred = rows.join(F.broadcast(sums.select(*keys, "mean")), keys)  # one row a category and threshold
    spread = centred.groupBy(*keys).agg(F.sqrt(F.sum((x - F.col("mean")) * (x - F.col("mean")) * F.col(weight)) / n).alias("std"))
    out = sums.join(spread, keys).withColumn("rate", F.col("n_cliffs") / F.col("n"))
    out = with_quantiles(out, keys, rows, difference, {"median": 0.5}, weight)
    return with_quantiles(out, keys, rows, sim, {"median_sim": 0.5}, weight)


def index_distribution(pairs: DataFrame, index: str, weight: str) -> DataFrame:
    """Different values of an index over pairs: n pairs that have it, and the share of pairs up to and with it (cdf)."""
    counts = cut(pairs.groupBy(index).agg(F.sum(weight).alias("n")))
    total = counts.agg(F.sum("n").alias("total"))
    return running_totals(counts, index, ["n"]).crossJoin(F.broadcast(total)).select(index, "n", (F.col("cum_n") / F.col("total")).alias("cdf"))  # one row
