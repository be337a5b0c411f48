"""Ranks, running totals and top-k without a window over all rows in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, few

#: Ranges that global orders are cut into: at least these, as many as shuffle partitions, and no more than the last.
LEAST_RANGES, MOST_RANGES = 32, 1000
#: Different values of a score up to which their ranks are broadcast: such values are held by many rows each.
FEW_VALUES = 10_000
#: Rows up to which the best are taken by a sort with a limit.
TOP = 10_000


def ranges(df: DataFrame) -> int:
    """How many ranges a global order over the rows is cut into."""
    return min(MOST_RANGES, max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def range_of(df: DataFrame, key: str) -> Column:
    """The range of a numeric key, between quantiles of its values: an expression over literals."""
    n = ranges(df)
    bounds = sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], min(0.01, 0.25 / n))))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key)))


def row_numbers(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the order given, which must tell all rows apart where ties matter.

    Rows are sorted over range partitions and numbered within; the numbers of
    rows in the partitions before (one row a partition) are then added.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_before") + within).drop("_at", "_part", "_before")


def running_totals(df: DataFrame, key: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Adds ``cum_<c>``, the sum of ``c`` up to and with each row in the order of a unique numeric key.

    The key's ranges are summed apart; totals of the ranges before (one row a
    range) are then added.
    """
    order = F.desc if descending else F.asc
    placed = df.withColumn("_range", range_of(df, key))
    within = Window.partitionBy("_range").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    out = placed.select("*", *[F.sum(c).over(within).alias(f"_w_{c}") for c in sums]).join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, *[(F.col(f"_w_{c}") + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in sums])


def _number(score: str) -> Column:
    """The score as a number; null for null and NaN, which take no part."""
    return F.when(~F.isnan(score), F.col(score).cast("double"))


def _counted(df: DataFrame, scores: list[str]) -> DataFrame:
    """Rows c, v, below, ties, total of each different value v of the score number c: one scan of ``df``, whatever the number of scores.

    Values of all scores are one table, which is cut into ranges of about equal
    size; (score, range) parts are summed apart, and the sums of the ranges before
    (one row a score and range) are then added.
    """
    wide = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), _number(s).alias("v")) for i, s in enumerate(scores)])))
    counts = cut(wide.where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("ties")))
    placed = counts.withColumn("r", range_of(counts, "v"))
    within = Window.partitionBy("c", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("c", "r").agg(F.sum("ties").alias("t"))
    before = F.sum("t").over(Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("c", "r", F.coalesce(before, F.lit(0)).alias("b"), F.sum("t").over(Window.partitionBy("c")).alias("total"))
    ranked = placed.withColumn("w", F.coalesce(F.sum("ties").over(within), F.lit(0))).join(F.broadcast(offsets), ["c", "r"])
    return cut(ranked.select("c", "v", (F.col("b") + F.col("w")).alias("below"), "ties", "total"))


def _looked_up(df: DataFrame, score: str, ranked: DataFrame) -> DataFrame:
    """Adds ``<score>_at`` from few rows (v, a)."""
    return df.join(F.broadcast(ranked.toDF("_w", f"{score}_at")), _number(score) == F.col("_w"), "left").drop("_w")


def all_positions(df: DataFrame, scores: list[str]) -> DataFrame:
    """Adds a struct ``<score>_at`` for each score: rows of lower score (below), of this score (ties), with a score (total).

    Null and NaN scores take no part and get a null.  Several scores are looked up
    as one long table of (row, score, value), which goes back to the rows once;
    those of few different values are looked up where the rows are.
    """
    at = F.struct("below", "ties", "total")
    if len(scores) == 1:
        (score,) = scores
        # Rows without a score would all meet in one task; each gets a key of its own, which finds nothing.
        keyed = df.withColumn("_v", _number(score)).withColumn("_lone", F.when(F.col("_v").isNull(), F.monotonically_increasing_id()))
        counted = _counted(df, scores)
        if few(counted, FEW_VALUES):
            return _looked_up(df, score, counted.select("v", at.alias("a"))).select(*df.columns, f"{score}_at")
        ranked = counted.select(F.col("v").alias("_w"), F.lit(None).cast("long").alias("_none"), at.alias(f"{score}_at"))
        found = keyed.join(ranked, F.col("_v").eqNullSafe(F.col("_w")) & F.col("_lone").eqNullSafe(F.col("_none")), "left")
        return found.select(*df.columns, f"{score}_at")
    rows = cut(df.withColumn("_id", F.monotonically_increasing_id()))
    ranked = _counted(rows, scores)
    sizes = {r.c: r["count"] for r in ranked.groupBy("c").count().collect()}  # one row a score
    many = [(i, s) for i, s in enumerate(scores) if sizes.get(i, 0) > FEW_VALUES]
    out = rows
    for i, s in enumerate(scores):
        if sizes.get(i, 0) <= FEW_VALUES:
            out = _looked_up(out, s, ranked.where(F.col("c") == i).select("v", at.alias("a")))
    if many:
        long = rows.select("_id", F.inline(F.array(*[F.struct(F.lit(i).alias("c"), _number(s).alias("v")) for i, s in many]))).where("v is not null")
        found = long.join(ranked, ["c", "v"]).groupBy("_id").agg(*[F.max(F.when(F.col("c") == i, at)).alias(f"{s}_at") for i, s in many])
        out = out.join(found, "_id", "left")
    return out.select(*df.columns, *[f"{s}_at" for s in scores])


def positions(df: DataFrame, score: str) -> DataFrame:
    """Adds ``below`` (rows of lower score), ``ties`` (rows of this score) and ``total`` (rows with a score).

    NaN and null scores take no part and get nulls.
    """
    return all_positions(df, [score]).select(*df.columns, *[F.col(f"{score}_at.{c}").alias(c) for c in ("below", "ties", "total")])


def _ranked(df: DataFrame, names: dict[str, str], rank) -> DataFrame:
    """Adds for each score, under its name in ``names``, what ``rank`` makes of below, ties and total."""
    out = all_positions(df, list(names))
    return out.select(*df.columns, *[rank(*(F.col(f"{s}_at.{c}") for c in ("below", "ties", "total"))).alias(n) for s, n in names.items()])


def rank_norms(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Average ascending rank over the number of scores, for each score under its name; null where there is no score."""
    return _ranked(df, names, lambda below, ties, total: (below + (ties + 1) / 2) / total)


def rank_norm(df: DataFrame, score: str, name: str) -> DataFrame:
    return rank_norms(df, {score: name})


def average_ranks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Average rank, 1 for the lowest score, for each score under its name."""
    return _ranked(df, names, lambda below, ties, total: below + (ties + 1) / 2)


def average_rank_desc(df: DataFrame, score: str, name: str) -> DataFrame:
    """Average rank, 1 for the highest score."""
    return _ranked(df, {score: name}, lambda below, ties, total: total - below - ties + (ties + 1) / 2)


def fractional_ranks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """(rows above + half the other ties) / (rows - 1), for each score under its name: 0 is the top."""
    return _ranked(df, names, lambda below, ties, total: (total - below - ties + 0.5 * (ties - 1)) / F.greatest(total - 1, F.lit(1)))


def fractional_rank(df: DataFrame, score: str, name: str) -> DataFrame:
    return fractional_ranks(df, {score: name})


def ordinal_rank(df: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """1, 2, ... by descending score, then key; rows without a score (null or NaN) last."""
    value = df.withColumn("_v", _number(score))
    return row_numbers(value, [F.desc_nulls_last("_v"), F.asc(key)], name).drop("_v").withColumn(name, F.col(name) + 1)


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, most: int | None = None, place: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group, with their number as ``place`` if asked for.

    ``n`` may be a column, such as a quota, of which ``most`` is the largest: a limit
    that is a number is applied before the shuffle, too, so that no group meets
    whole in one task.
    """
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if most is not None:
        numbered = numbered.where(F.col("_rn") <= most)
    kept = numbered.where(F.col("_rn") <= n)
    return kept.withColumnRenamed("_rn", place) if place else kept.drop("_rn")


def top_or_threshold(df: DataFrame, score: str, key: str, n: int | None = None, threshold: float | None = None) -> DataFrame:
    """The ``n`` best rows, or those from ``threshold`` on; exactly one of the two."""
    if (n is None) == (threshold is None):
        raise ValueError("give either n or threshold")
    if n is None:
        return df.where(F.col(score) >= threshold)
    order = [F.desc_nulls_last(score), F.asc(key)]
    # The rows of a limit meet in one task, so a large one goes by numbers.
    return df.orderBy(*order).limit(n) if n <= TOP else row_numbers(df, order, "_place").where(F.col("_place") < n).drop("_place")


def balanced(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """All positives and as many negatives, chosen by a seeded hash of the key; all of them if they are no more."""
    positives, negatives = df.where(F.col(label) == 1), df.where(F.col(label) != 1)
    lot = F.xxhash64(F.lit(seed), F.col(key))
    chosen = row_numbers(negatives.withColumn("_lot", lot), ["_lot", key], "_place").where(F.col("_place") < positives.count())
    return positives.unionByName(chosen.drop("_lot", "_place"))


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows, the same for the same seed and rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def top_k_mean(df: DataFrame, key: str, value: str, k: int, name: str) -> DataFrame:
    """Mean of the k largest values of each key (all, if fewer)."""
    return top_per_group(df.where(F.col(value).isNotNull()), [key], [F.desc(value)], k).groupBy(key).agg(F.avg(value).alias(name))


def running_best(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(value).over(w))
