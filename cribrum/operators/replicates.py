"""Measurements with replicates: averaging, collapsing, ambiguity, reproducibility, batch effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def average_by_batch(df: DataFrame, key: str, batch: str, value: str, first: list[str], order: str) -> DataFrame:
    """One row per id and batch: first non-null attributes in the order given, mean, sample deviation, count of values."""
    attrs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return df.groupBy(key, batch).agg(*attrs, F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def collapse(df: DataFrame, key: str, batch: str, mean: str, first: list[str]) -> DataFrame:
    """One row per id from batch means (not pooled): mean and deviation of the means, number of batches, first attributes by batch."""
    attrs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(batch))).alias(c) for c in first]
    return df.groupBy(key).agg(*attrs, F.avg(mean).alias("global_mean"), F.stddev_samp(mean).alias("global_std"), F.count_distinct(F.col(batch)).alias("n_batches"))


def median_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median of each id; null where an id has no values."""
    return with_quantiles(df.select(key).distinct(), [key], df, value, {"median": 0.5})


def ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Ids with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(F.col(value)).alias("n_values")).where("n_values > 1")


def unambiguous_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.join(ambiguous(df, key, value), key, "left_anti")


def batch_stats(df: DataFrame, batch: str, key: str, value: str) -> DataFrame:
    """Per batch, nulls dropped first: n, distinct ids, mean, median, sample deviation, quartiles."""
    rows = df.where(F.col(value).isNotNull())
    sums = rows.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(key)).alias("n_ids"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    return with_quantiles(sums, [batch], rows, value, {"median": 0.5, "q25": 0.25, "q75": 0.75}).select(batch, "n", "n_ids", "mean", "median", "std", "q25", "q75")


def within_key_spread(df: DataFrame, key: str, batch: str, value: str) -> DataFrame:
    """Per id: n, batches, mean, sample deviation, min, max, range."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct(F.col(batch)).alias("n_batches"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
        .withColumn("range", F.col("max") - F.col("min"))
    )


def reproducibility(spread: DataFrame) -> DataFrame:
    """Over ids with two values at least: how large the deviations are."""
    rows = spread.where("n >= 2")
    sums = rows.agg(F.count(F.lit(1)).alias("n_ids"), F.avg("std").alias("mean_std"), F.max("std").alias("max_std"))
    places = quantiles(rows, "std", {"median_std": 0.5, "p90_std": 0.9})
    return sums.crossJoin(places).select("n_ids", "median_std", "mean_std", "p90_std", "max_std")  # one row each


def variance_explained(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way R2 = between-group over total sum of squares (null if the total is 0), and the spread of group medians."""
    rows = df.where(F.col(value).isNotNull())
    sums = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    groups = cut(with_quantiles(sums, [group], rows, value, {"median": 0.5}))
    grand = groups.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    parts = groups.crossJoin(F.broadcast(grand))  # one row
    between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2)))
    within = F.sum(F.col("n") * F.col("var"))
    return parts.agg(
        F.when(between + within > 0, between / (between + within)).alias("r2"), (F.max("median") - F.min("median")).alias("median_spread"), F.count(F.lit(1)).alias("n_groups")
    )


def composition(df: DataFrame, a: str, b: str, key: str, value: str) -> DataFrame:
    """Per pair of groups: distinct ids, median, mean, rows (nulls counted as rows)."""
    sums = df.groupBy(a, b).agg(F.count_distinct(F.col(key)).alias("n_ids"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n_rows"))
    return with_quantiles(sums, [a, b], df, value, {"median": 0.5}).select(a, b, "n_ids", "median", "mean", "n_rows")


def distribution(df: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, sample deviation, extremes and exact quantiles."""
    sums = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    places = quantiles(df, value, {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9})
    return sums.crossJoin(places).select("count", "mean", "std", "min", "q25", "median", "q75", "q90", "max")  # one row each


def _same(left: list[str], right: list[str]) -> Column:
    """Equality of keys, where nulls are equal."""
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def group_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """Rows of keys and exact quantiles, interpolated between neighbours; each value counts ``weight`` times (once).

    Nulls take no part; groups without values give no row (without keys: one row of
    nulls).  Different values of a group are counted and cut into ranges of all
    values, so that a (group, range) part is at most a range, however large the
    group; sums of the ranges before are then added.
    """
    from .ranking import range_of

    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(times.alias("_c")))
    placed = counts.withColumn("_r", range_of(counts, "_v"))
    within = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*keys, "_r").agg(F.sum("_c").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    own = [f"_k{i}" for i in range(len(keys))]
    offsets = sums.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("_r").alias("_q"), F.coalesce(before, F.lit(0)).alias("_b"), F.sum("_t").over(Window.partitionBy(*keys)).alias("_n"))
    reach = placed.withColumn("_w", F.sum("_c").over(within)).join(offsets, _same([*keys, "_r"], [*own, "_q"])).withColumn("_cum", F.col("_w") + F.col("_b"))
    place = {name: F.lit(q) * (F.col("_n") - 1) for name, q in wanted.items()}
    sides = [F.min(F.when(F.col("_cum") > side(p), F.col("_v"))).alias(f"_{name}_{i}") for name, p in place.items() for i, side in enumerate((F.floor, F.ceil))]
    shares = [F.max(p - F.floor(p)).alias(f"_{name}_s") for name, p in place.items()]
    found = reach.groupBy(*keys).agg(*sides, *shares)
    return found.select(*keys, *[(F.col(f"_{n}_0") + (F.col(f"_{n}_1") - F.col(f"_{n}_0")) * F.col(f"_{n}_s")).alias(n) for n in wanted])


def with_quantiles(groups: DataFrame, keys: list[str], df: DataFrame, value: str, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """Adds to one row a group the quantiles of its rows in ``df``; null where it has no values."""
    own = [f"_g{i}" for i in range(len(keys))]
    found = group_quantiles(df, keys, value, wanted, weight).toDF(*own, *wanted)
    return groups.join(found, _same(keys, own), "left").drop(*own)


def quantiles(df: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """One row: exact quantiles, interpolated between neighbours; nulls take no part, and all are null without values."""
    return group_quantiles(df, [], value, wanted)


def nearest_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row, ``quantile``: the value at place round(q * (n - 1)) of the sorted values."""
    from .ranking import running_totals

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cumulative = running_totals(counts, "v", ["c"])
    place = cumulative.agg(F.round(F.lit(q) * (F.sum("c") - 1)).alias("place"))
    return cumulative.crossJoin(F.broadcast(place)).where(F.col("cum_c") > F.col("place")).agg(F.min("v").alias("quantile"))


def lookup_cascade(df: DataFrame, key: str, sources: list[tuple[str, DataFrame]], name: str, unresolved: str = "unresolved") -> DataFrame:
    """Adds ``name`` and ``<name>_source`` from the first source (key, value) that has the key; sources have unique keys."""
    out = df
    for i, (_, source) in enumerate(sources):
        out = out.join(source.toDF(key, f"_s{i}"), key, "left")
    value = F.coalesce(*[F.col(f"_s{i}") for i in range(len(sources))])
    origin = F.lit(unresolved)
    for i, (label, _) in reversed(list(enumerate(sources))):
        origin = F.when(F.col(f"_s{i}").isNotNull(), F.lit(label)).otherwise(origin)
    return out.withColumn(name, value).withColumn(f"{name}_source", origin).select(*df.columns, name, f"{name}_source")


def enrich_strict(df: DataFrame, other: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """A left join whose columns may not be null: a missing partner fails the job where it is found."""
    out = df.join(other.select(on, *columns), on, "left")
    checked = [F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"no {c} for "), F.col(on).cast("string"))).cast(other.schema[c].dataType)).alias(c) for c in columns]
    return out.select(*[c for c in out.columns if c not in columns], *checked)


def join_all(tables: list[tuple[str, DataFrame]], on: list[str], value: str) -> DataFrame:
    """Inner join of prediction tables on the same keys, each one's value under its name."""
    out = None
    for name, df in tables:
        one = df.select(*on, F.col(value).alias(name))
        out = one if out is None else out.join(one, on)
    return out


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in the order given, as when a map is filled row by row."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
