"""Points: radius joins on a grid, contacts, boxes; components within groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import distance
from .lineage import cut, few

_XYZ = ("x", "y", "z")


#: Rows of one side of a cell up to which it is one key; a fuller cell is cut in eight, at most so many times, then dealt out.
CELL_ROWS, DEPTH = 4096, 6


def _reaches(point: list[Column], cell: list[Column], width: float, cutoff: float) -> Column:
    """Whether a ball of radius ``cutoff`` around the point meets the cell; a little wider, for rounding."""
    gaps = [F.greatest(c * width - p, p - (c + 1) * width, F.lit(0.0)) for p, c in zip(point, cell)]
    return sum((g * g for g in gaps), F.lit(0.0)) <= cutoff * cutoff * (1 + 1e-9)


def radius_join(left: DataFrame, right: DataFrame, cutoff: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs of points (columns x, y, z) at most ``cutoff`` apart, with their distance; other columns get l_ and r_.

    The grid adapts: right points fall into cells of the cutoff's width, and cells of
    more than ``cell_rows`` of them into cells of half that width, and so on.  Each left
    point looks into the cells of the first width around it, and goes on into the
    smaller ones of those that are cut, as far as its ball meets them; so it meets
    right points in cells of any width.  What is still crowded on either side then,
    such as points at one place, is dealt out: every part of the one side meets every
    part of the other, so that no key has more than about ``cell_rows`` rows of a side.
    Points with a null coordinate pair with nothing.
    """
    at = [f"_{c}" for c in _XYZ]
    given_l, given_r = [f"l_{c}" for c in left.columns], [f"r_{c}" for c in right.columns]

    def placed(points: DataFrame, names: list[str], side: str) -> DataFrame:
        known = points.toDF(*names)
        for c in _XYZ:
            known = known.where(F.col(f"{side}_{c}").isNotNull() & ~F.isnan(f"{side}_{c}"))
        return cut(known.withColumns({f"_{c}": F.floor(F.col(f"{side}_{c}") / cutoff) for c in _XYZ}).withColumn("_lot", F.monotonically_increasing_id()))

    a, b = placed(left, given_l, "l"), placed(right, given_r, "r")
    for c in _XYZ:
        a = a.withColumn(f"_{c}", F.explode(F.array(*[F.col(f"_{c}") + i for i in (-1, 0, 1)])))
    pairs, width = [], cutoff
    for depth in range(DEPTH + 1):
        count = b.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
        crowded = cut(count.where(F.col("_n") > cell_rows))
        deeper = depth < DEPTH and not crowded.isEmpty()
        fits_a, fits_b = (a.join(crowded, at, "left_anti"), b.join(crowded, at, "left_anti")) if deeper else (a, b)
        pairs.append(_meet(fits_a, fits_b, at, cell_rows))
        if not deeper:
            break
        width /= 2
        b = cut(b.join(crowded.select(*at), at, "left_semi").withColumns({f"_{c}": F.floor(F.col(f"r_{c}") / width) for c in _XYZ}))
        a = a.join(crowded.select(*at), at, "left_semi")
        for c in _XYZ:
            a = a.withColumn(f"_{c}", F.explode(F.array(*[2 * F.col(f"_{c}") + i for i in (0, 1)])))
        a = cut(a.where(_reaches([F.col(f"l_{c}") for c in _XYZ], [F.col(c) for c in at], width, cutoff)))
    apart = distance([F.col(f"l_{c}") for c in _XYZ], [F.col(f"r_{c}") for c in _XYZ])
    out = reduce(DataFrame.unionByName, [p.select(*given_l, *given_r) for p in pairs])
    return out.withColumn("distance", apart).where(F.col("distance") <= cutoff)


def _boxes(points: DataFrame, key: str, width: float, rows: int) -> DataFrame:
    """Points of a cell, ``rows`` at most, as matrices: ids, data (float64, row-major) and the bounds lo and hi; a null or NaN coordinate drops a point."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xyz = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _XYZ])
            cells = np.floor(xyz / width)
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1), len(xyz)]
            for start, end in zip(cuts, cuts[1:]):
                for lo in range(start, end, rows):
                    part = xyz[lo : min(lo + rows, end)]
                    ids = batch.column("k").slice(lo, len(part)).to_pylist()
                    yield pa.RecordBatch.from_pylist([{"ids": ids, "data": part.tobytes(), "lo": part.min(axis=0).tolist(), "hi": part.max(axis=0).tolist()}])

    known = points.select(F.col(key).cast("long").alias("k"), *_XYZ)
    for c in _XYZ:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(c))
    at = [F.floor(F.col(c) / width) for c in _XYZ]
    return cut(known.repartitionByRange(*at).sortWithinPartitions(*at).mapInArrow(pack, "ids array<long>, data binary, lo array<double>, hi array<double>"))


def radius_summary(left: DataFrame, right: DataFrame, key: str, cutoff: float, rows: int = CELL_ROWS) -> DataFrame:
    """Per left point with any: key, n (right points at most ``cutoff`` away) and farthest (distance of the last of these).

    For what ``radius_join`` would give, but no pair is a row: points of a cell meet
    those of cells in reach as matrices, of ``rows`` points at most on a side, a group
    for each meeting; a left point has a row a meeting, and these are then added.
    """

    def meet(group: pa.Table) -> pa.Table:
        found = []
        for row in group.to_pylist():
            ids = np.array(row["l_ids"])
            a, b = (np.frombuffer(row[c]).reshape(-1, 3) for c in ("l_data", "r_data"))
            for lo in range(0, len(a), 256):
                gaps = [a[lo : lo + 256, None, i] - b[None, :, i] for i in range(3)]
                squares = gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]
                near = squares <= cutoff * cutoff
                n = near.sum(axis=1)
                far = np.where(near, squares, -1.0).max(axis=1)
                found.append(pa.table({"k": ids[lo : lo + 256][n > 0], "n": n[n > 0].astype(np.int64), "far": np.sqrt(far[n > 0])}))
        return pa.concat_tables(found)

    a, b = (_boxes(side, key, cutoff, rows).toDF(*[f"{s}_{c}" for c in ("ids", "data", "lo", "hi")]) for side, s in ((left, "l"), (right, "r")))
    gaps = [F.greatest(F.get("l_lo", F.lit(i)) - F.get("r_hi", F.lit(i)), F.get("r_lo", F.lit(i)) - F.get("l_hi", F.lit(i)), F.lit(0.0)) for i in range(3)]
    both = a.join(b, sum((g * g for g in gaps), F.lit(0.0)) <= cutoff * cutoff * (1 + 1e-9)).select("l_ids", "l_data", "r_data", F.get("r_ids", F.lit(0)).alias("_r"))
    found = both.groupBy(F.get("l_ids", F.lit(0)).alias("_l"), "_r").applyInArrow(meet, "k long, n long, far double")
    return found.groupBy(F.col("k").alias(key)).agg(F.sum("n").alias("n"), F.max("far").alias("farthest"))


def _meet(a: DataFrame, b: DataFrame, at: list[str], most: int) -> DataFrame:
    """Rows of one cell; cells of more than ``most`` rows on a side in parts, each of which meets all parts of the other side."""

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))

    load = cut(parts(a, "_pa").join(parts(b, "_pb"), at))
    many = load.where("_pa > 1 or _pb > 1")
    if many.isEmpty():
        return a.drop("_lot").join(b.drop("_lot"), at)
    plain = a.drop("_lot").join(load.where("_pa = 1 and _pb = 1").select(*at), at, "left_semi").join(b.drop("_lot"), at)
    lot = F.pmod(F.xxhash64("_lot"), F.col("_own")).cast("int")
    da = a.join(many.withColumnRenamed("_pa", "_own"), at).withColumn("_i", lot).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_pb") - 1))).drop("_own", "_pb", "_lot")
    db = b.join(many.withColumnRenamed("_pb", "_own"), at).withColumn("_j", lot).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_pa") - 1))).drop("_own", "_pa", "_lot")
    return plain.unionByName(da.join(db, [*at, "_i", "_j"]).drop("_i", "_j"))


def nearest_contacts(pairs: DataFrame, group: str, member: str) -> DataFrame:
    """Least distance of each (group, member)."""
    return pairs.groupBy(group, member).agg(F.min("distance").alias("distance"))


def typed_contacts(pairs: DataFrame, rules: list[tuple[str, Column]], once_per: list[str], nearest_only: str) -> DataFrame:
    """One row per pair and rule that holds; of the type ``nearest_only`` only the nearest per ``once_per``."""
    kinds = F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in rules]))
    typed = pairs.withColumn("type", F.explode(kinds))
    order = Window.partitionBy(*once_per, "type").orderBy("distance")
    return typed.withColumn("_rn", F.row_number().over(order)).where((F.col("type") != nearest_only) | (F.col("_rn") == 1)).drop("_rn")


def bounding_boxes(points: DataFrame, group: str, padding: float) -> DataFrame:
    out = [f(c).alias(f"{c}_{n}") for c in _XYZ for n, f in (("centre", F.avg), ("min", F.min), ("max", F.max))]
    boxes = points.groupBy(group).agg(*out)
    return boxes.select(group, *[F.col(f"{c}_centre") for c in _XYZ], *[(F.col(f"{c}_max") - F.col(f"{c}_min") + padding).alias(f"{c}_size") for c in _XYZ])


#: Rows of groups, parts and elements that a task takes, and parts of an element up to which they are in one lot.
TASK_ROWS, LOT_ROWS = 500_000, 100_000
#: Elements of many parts, and groups, up to which they are broadcast.
BROADCAST_ELEMENTS, BROADCAST_GROUPS = 100_000, 500_000


def _tasks(rows: DataFrame) -> int:
    """How many parts to deal a written table into, so that a task's rows, and with them its memory, do not grow with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def _in_lots(ends: DataFrame) -> DataFrame:
    """The ends (g, p, e), where an element of more than ``LOT_ROWS`` parts is one for each lot of about so many.

    The least part of each lot also has an end at one further element, which all lots
    of an element share, so the same parts are joined.
    """
    many = cut(ends.groupBy("g", "e").agg(F.ceil(F.count(F.lit(1)) / LOT_ROWS).alias("lots")).where("lots > 1"))
    if many.isEmpty():
        return ends
    many = F.broadcast(many) if few(many, BROADCAST_ELEMENTS) else many
    plain = ends.join(many, ["g", "e"], "left_anti").select("g", "p", F.struct("e", F.lit(0).alias("lot")).alias("e"))
    dealt = cut(ends.join(many, ["g", "e"]).select("g", "p", "e", (F.pmod(F.xxhash64("p"), "lots") + 1).cast("int").alias("lot")))
    links = dealt.groupBy("g", "e", "lot").agg(F.min("p").alias("p")).select("g", "p", F.struct("e", F.lit(0).alias("lot")).alias("e"))
    return cut(plain.unionByName(dealt.select("g", "p", F.struct("e", "lot").alias("e"))).unionByName(links))


def _spread_labels(ends: DataFrame) -> DataFrame:
    """Rows g, p, c of rows g, p, e: the least part of the component of each part, where parts of one g with a common e are joined.

    Labels go from parts to elements and back until none changes, and each turn also
    takes the label of the label's part; so an element of many parts costs a row for
    each, and no pair.  Each turn starts from a table and goes on with the groups that
    it has changed.  Rows are dealt out by their number: so many more tasks, and none
    of them larger.
    """
    n, label, done = _tasks(ends), None, []
    while True:
        # At first each part has its own label.
        known = ends.withColumn("c", F.col("p")) if label is None else ends.repartition(n, "g", "p").join(label.repartition(n, "g", "p"), ["g", "p"])
        of_element = known.repartition(n, "g", "e").withColumn("m", F.min("c").over(Window.partitionBy("g", "e")))
        step = of_element.select("g", "p", "c", "m").repartition(n, "g", "p").groupBy("g", "p").agg(F.first("c").alias("old"), F.min("m").alias("c"))
        if label is not None:
            far = label.select("g", F.col("p").alias("c"), F.col("c").alias("f")).repartition(n, "g", "c")
            step = step.repartition(n, "g", "c").join(far, ["g", "c"]).select("g", "p", "old", F.least("c", "f").alias("c"))
        step = cut(step)
        labels, moved = step.select("g", "p", "c"), cut(step.where("old <> c").select("g").distinct())
        if moved.isEmpty():
            return reduce(DataFrame.unionByName, [*done, labels])
        if few(moved, BROADCAST_GROUPS):
            moved = F.broadcast(moved)
            ends = cut(ends.join(moved, "g", "left_semi"))
            n = _tasks(ends)
        done.append(labels.join(moved, "g", "left_anti"))
        label = labels.join(moved, "g", "left_semi")


def _sharing(rows: DataFrame, shared: int) -> DataFrame:
    """Rows g, p, e: an own e for each pair of parts of one g with ``shared`` common elements or more.

    Such parts have a common element besides the ``shared`` - 1 most frequent ones of
    each, so pairs come from the rest only, and their elements are then counted.
    """
    part = Window.partitionBy("g", "p")
    held = rows.withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("g", "e"))).withColumn("k", F.row_number().over(part.orderBy(F.desc("f"), "e")))
    # All elements of a part go along with it, so that a pair is compared where it is found.
    rest = cut(held.withColumn("s", F.collect_list("e").over(part)).where((F.col("k") >= shared) & (F.col("f") > 1)).select("g", "p", "e", "s"))
    near = rest.toDF("g", "a", "e", "sa").join(rest.toDF("g", "b", "e", "sb"), ["g", "e"]).where("a < b")
    both = near.where(F.size(F.array_intersect("sa", "sb")) >= shared).select("g", "a", "b").distinct()
    return both.select("g", F.explode(F.array("a", "b")).alias("p"), F.struct("a", "b").alias("e"))


def largest_components(members: DataFrame, group: str, part: str, element: str, shared: int) -> DataFrame:
    """Per group: size of its largest component of parts that share ``shared`` elements or more; 0 where nothing is joined.

    For one shared element labels spread over parts and elements; for more, over the
    pairs that have them.  Rows with a null group, part or element join nothing.
    """
    given = cut(members.select(F.col(group).alias("g"), F.col(part).alias("p"), F.col(element).alias("e")))
    rows = cut(given.where("g is not null and p is not null and e is not null").repartition(_tasks(given), "g", "p").distinct())
    # An element of a pair has two parts and needs no lots.
    ends = _in_lots(rows) if shared == 1 else cut(_sharing(rows, shared))
    sizes = _spread_labels(ends).groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.where("n > 1").groupBy("g").agg(F.max("n").alias("n"))
    groups = given.select("g").distinct()
    return groups.join(largest, "g", "left").select(F.col("g").alias(group), F.coalesce("n", F.lit(0)).alias("largest"))
