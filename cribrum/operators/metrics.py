"""Exact, tie-aware metrics over (label, score) tables."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut
from .ranking import average_ranks, positions, ranges, running_totals
from .replicates import quantiles, with_quantiles


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score (as threshold): n, pos here and cum_n, cum_pos from the top; all_pos and all_neg in all.

    Rows without label or score take no part.
    """
    usable = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    counts = usable.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    totals = counts.agg(F.sum("pos").alias("all_pos"), (F.sum("n") - F.sum("pos")).alias("all_neg"))
    return running_totals(counts, "threshold", ["n", "pos"], descending=True).crossJoin(F.broadcast(totals))  # one row


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row, ``auroc``: share of (positive, negative) pairs in order, ties half; null for one class."""
    c = curve(df, label, score)
    neg, above = F.col("n") - F.col("pos"), F.col("cum_pos") - F.col("pos")
    return c.agg((F.sum(neg * above + 0.5 * neg * F.col("pos")) / F.when(F.max("all_pos") * F.max("all_neg") > 0, F.max("all_pos") * F.max("all_neg"))).alias("auroc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row, ``ap``: the step-wise sum of recall gained times precision."""
    return curve(df, label, score).agg(F.sum(F.col("pos") / F.when(F.col("all_pos") > 0, F.col("all_pos")) * F.col("cum_pos") / F.col("cum_n")).alias("ap"))


def pr_trapezoid(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row, ``pr_auc``: the area under the precision-recall points joined by lines, from recall 0 at precision 1."""
    here = F.col("cum_pos") / F.col("cum_n")
    before = F.when(F.col("cum_n") > F.col("n"), (F.col("cum_pos") - F.col("pos")) / (F.col("cum_n") - F.col("n"))).otherwise(1.0)
    return curve(df, label, score).agg(F.sum(F.col("pos") / F.when(F.col("all_pos") > 0, F.col("all_pos")) * (here + before) / 2).alias("pr_auc"))


def points(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, fpr, tpr (recall), precision, f1 where rows from the threshold on are called positive."""
    precision, recall = F.col("cum_pos") / F.col("cum_n"), F.col("cum_pos") / F.col("all_pos")
    return curve(df, label, score).select(
        "threshold", ((F.col("cum_n") - F.col("cum_pos")) / F.col("all_neg")).alias("fpr"), recall.alias("tpr"), precision.alias("precision"),
        (2 * F.col("cum_pos") / (F.col("cum_n") + F.col("all_pos"))).alias("f1"), F.col("cum_pos").alias("tp"), (F.col("cum_n") - F.col("cum_pos")).alias("fp"),
        (F.col("all_pos") - F.col("cum_pos")).alias("fn"), (F.col("all_neg") - F.col("cum_n") + F.col("cum_pos")).alias("tn"),
    )


def best_f1(df: DataFrame, label: str, score: str) -> DataFrame:
    """The row of ``points`` of the highest F1, the higher threshold among equals."""
    p = points(df, label, score)
    return p.agg(F.max(F.struct("f1", "threshold", "precision", "tpr", "tp", "fp", "fn", "tn")).alias("b")).select("b.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Counts and what follows from them at a threshold (score >= threshold): precision, recall, f1, balanced accuracy, mcc."""
    yes, called = F.col(label) == 1, F.col(score) >= threshold
    c = df.agg(*[F.count_if(x).alias(n) for n, x in (("tp", yes & called), ("fp", ~yes & called), ("fn", yes & ~called), ("tn", ~yes & ~called))])
    tp, fp, fn, tn = (F.col(n).cast("double") for n in ("tp", "fp", "fn", "tn"))
    return c.select(
        "*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"), _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mean squared error and that of the prevalence, p(1 - p)."""
    y = F.col(label).cast("double")
    return df.agg(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), (F.avg(y) * (1 - F.avg(y))).alias("baseline"), F.count(F.lit(1)).alias("n"))


def top_precision(df: DataFrame, label: str, score: str, key: str, ks: list[int]) -> DataFrame:
    """Hits among the k highest scores, and how many chance would give."""
    top = df.orderBy(F.desc_nulls_last(score), key).limit(max(ks)).select(label, score, key)
    rows = top.agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(label).cast("int").alias("y")))).alias("top"))  # max(ks) rows
    base = df.agg(F.avg(F.col(label).cast("double")).alias("prevalence"))
    wanted = rows.crossJoin(base).select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "top", "prevalence")
    hits = F.aggregate(F.slice("top", F.lit(1), F.col("k")), F.lit(0), lambda s, x: s + x["y"])
    return wanted.select("k", hits.alias("hits"), (hits / F.col("k")).alias("precision"), (F.col("k") * F.col("prevalence")).alias("by_chance"))


def regression_errors(df: DataFrame, y: str, p: str, train_mean: float) -> DataFrame:
    """MSE, RMSE, MAE, R2 and the RMSE of a constant prediction."""
    e = F.col(y) - F.col(p)
    mse, var = F.avg(e * e), F.var_pop(y)
    base = F.avg((F.col(y) - train_mean) * (F.col(y) - train_mean))
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(var > 0, 1 - mse / var).alias("r2"), F.sqrt(base).alias("baseline_rmse"))


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson, and Spearman as Pearson of average ranks; rows with a null take no part."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return average_ranks(both.select(a, b), {a: "_ra", b: "_rb"}).agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def kendall_by_group(df: DataFrame, group: str, key: str, a: str, b: str) -> DataFrame:
    """Kendall tau-b of each (small) group from its pairs of rows; null where one side is constant."""
    x, y = df.select(group, F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")).alias("x"), df.select(group, F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")).alias("y")
    pairs = x.join(y, group).where("x.k < y.k").select(group, F.signum(F.col("x.a") - F.col("y.a")).alias("sa"), F.signum(F.col("x.b") - F.col("y.b")).alias("sb"))
    p = pairs.groupBy(group).agg(F.sum(F.col("sa") * F.col("sb")).alias("s"), F.sum(F.abs("sa")).alias("na"), F.sum(F.abs("sb")).alias("nb"))
    return p.select(group, F.when(F.col("na") * F.col("nb") > 0, F.col("s") / F.sqrt(F.col("na") * F.col("nb"))).alias("tau_b"))


def agreement(u: np.ndarray, v: np.ndarray) -> int:
    """Sum over pairs of sign(u - u') * sign(v - v'): pairs in order less pairs out of order, by merging.

    Values are sorted by (u, v); at each level neighbouring blocks are compared by
    searches in their sorted values.  Pairs that tie in u are in order then, and are taken off.
    """
    n = len(u)
    if n < 2:
        return 0
    v = np.unique(v, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    base, total, width = np.int64(v.max() + 1), 0, 1
    where = np.arange(n)
    while width < n:
        block = where // (2 * width)
        left = where % (2 * width) < width
        key = np.sort(block[left] * base + v[left])
        mine = block[~left] * base + v[~left]
        first = np.searchsorted(key, block[~left] * base)
        last = np.searchsorted(key, (block[~left] + 1) * base)
        below, upto = np.searchsorted(key, mine), np.searchsorted(key, mine, "right")
        total += int((below - first).sum() - (last - upto).sum())
        width *= 2
    new = np.concatenate([[True], u[1:] != u[:-1]])
    both = new | np.concatenate([[True], v[1:] != v[:-1]])
    ties, same = (np.diff(np.append(np.flatnonzero(x), n)) for x in (new, both))
    return total - (int((ties * (ties - 1) // 2).sum()) - int((same * (same - 1) // 2).sum()))


def _ranges_with_singles(df: DataFrame, key: str) -> tuple[Column, Column]:
    """The range of a numeric key, and whether the range is one value: a value that fills quantiles has a range of its own."""
    n = ranges(df)
    cuts = df.approxQuantile(key, [i / n for i in range(1, n)], min(0.01, 0.25 / n))
    full = sorted({x for x, y in itertools.pairwise(cuts) if x == y})
    bounds = sorted({*cuts, *(math.nextafter(x, math.inf) for x in full)})
    if not bounds:
        return F.lit(0), F.lit(False)
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key)))
    return place, F.col(key).isin(full) if full else F.lit(False)


def _range_agreement(first: str, second: str):
    """Per range of rows that come sorted by it: the agreement of two columns; several ranges of a task one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, []

        def close() -> int:
            return agreement(*(np.concatenate([h[c] for h in held]) for c in (1, 2))) if held else 0

        for batch in batches:
            part, u, v = (batch.column(c).to_numpy() for c in ("part", first, second))
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
            for lo, hi in itertools.pairwise(edges):
                if hi > lo:
                    if held and held[0][0] != part[lo]:
                        total, held = total + close(), []
                    held.append((part[lo], u[lo:hi], v[lo:hi]))
        yield pa.RecordBatch.from_arrays([pa.array([total + close()], pa.int64())], names=["s"])

    return run


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Kendall tau-b of all rows with both values, and their number n; null where one side is constant.

    Pairs in order less pairs out of order, counted apart: pairs of different ranges
    on both sides from the counts of a-range by b-range (at most a million numbers
    on the driver); pairs of one a-range in that range; pairs of one b-range and
    different a-ranges in that b-range, where a is its range.  A task has one range
    of about equal size at a time, whose pairs are counted by merging; a value
    that fills ranges has one for itself, where all pairs tie.
    """
    values = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    rows = cut(values.where(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.isnan("a") & ~F.isnan("b")))
    (ra, single_a), (rb, single_b) = _ranges_with_singles(rows, "a"), _ranges_with_singles(rows, "b")
    placed = cut(rows.select("a", "b", ra.cast("long").alias("ra"), rb.cast("long").alias("rb"), single_a.alias("sa"), single_b.alias("sb")))

    def inside(part: str, first: str, second: str, single: str) -> DataFrame:
        own = placed.where(~F.col(single)).select(F.col(part).alias("part"), F.col(first).alias("u"), F.col(second).alias("v"))
        return own.repartition("part").sortWithinPartitions("part").mapInArrow(_range_agreement("u", "v"), "s long")

    part = inside("ra", "a", "b", "sa").union(inside("rb", "ra", "b", "sb")).agg(F.sum(F.col("s").cast("decimal(38,0)"))).first()[0]
    cells = placed.groupBy("ra", "rb").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(c.n for c in cells)
    grid = np.zeros((max((c.ra for c in cells), default=0) + 1, max((c.rb for c in cells), default=0) + 1), np.int64)
    for c in cells:
        grid[c.ra, c.rb] = c.n
    # Of each cell: what lies behind it in both, less what lies behind it in one and before it in the other.
    below = np.cumsum(grid[::-1], axis=0)[::-1] - grid
    before = np.cumsum(below, axis=1)
    ahead = before[:, -1:] - before - (before - below)
    across = sum(int(n) * int(x) for n, x in zip(grid.ravel(), ahead.ravel()) if n)
    ties = [
        placed.groupBy(c).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("t")).agg(F.coalesce(F.sum(F.col("t") * (F.col("t") - 1) / 2), F.lit(0))).first()[0] for c in ("a", "b")
    ]
    pairs = total * (total - 1) // 2
    free = [pairs - int(t) for t in ties]
    tau = (across + int(part or 0)) / (math.sqrt(free[0]) * math.sqrt(free[1])) if all(free) else None
    return df.sparkSession.createDataFrame([(tau, total)], "tau_b double, n long")


def signed_ranks(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of the paired differences a - b other than 0: n, W+ and W- over average ranks of |d|, tie term, median difference."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("d"))
    median = quantiles(d, "d", {"median_diff": 0.5})
    ranked = positions(d.where("d <> 0").withColumn("m", F.abs("d")), "m").withColumn("r", F.col("below") + (F.col("ties") + 1) / 2)
    sums = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.col("ties") * F.col("ties") - 1), F.lit(0)).alias("tie_term"),
    )
    return sums.crossJoin(median)  # one row each


def signed_rank_p(n: int, w_plus: float, w_minus: float, tie_term: float) -> float | None:
    """Two-sided p-value: exact for up to 50 differences without ties, else by the normal approximation; None below 2."""
    if n < 2:
        return None
    w = min(w_plus, w_minus)
    if n <= 50 and tie_term == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return math.erfc(max(0.0, (mean - w) / math.sqrt(var)) / math.sqrt(2)) if var > 0 else 1.0


def compare_models(spark: SparkSession, df: DataFrame, models: list[str], alpha: float = 0.05) -> DataFrame:
    """Signed-rank test of each pair of models, with the Bonferroni decision; the driver holds one row a pair."""
    rows, pairs = [], list(itertools.combinations(models, 2))
    for a, b in pairs:
        r = signed_ranks(df, a, b).first()
        p = signed_rank_p(r.n, r.w_plus, r.w_minus, r.tie_term)
        rows.append((a, b, r.n, float(min(r.w_plus, r.w_minus)), r.median_diff, p, p is not None and p < alpha / len(pairs)))
    return spark.createDataFrame(rows, "model_a string, model_b string, n long, w double, median_diff double, p double, significant boolean")


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def studentized_range_cdf(q: float, k: int, df: float) -> float:
    """P(range of k normals / independent standard deviation estimate <= q), by quadrature."""
    if q <= 0:
        return 0.0
    z = np.linspace(-8, 8, 801)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    normal = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))

    def range_cdf(w: np.ndarray) -> np.ndarray:
        low = np.interp(z[None, :] - w[:, None], z, normal, left=0.0)
        return k * np.trapezoid(density * np.clip(normal - low, 0, 1) ** (k - 1), z, axis=1)

    if df > 5000:
        return float(range_cdf(np.array([q]))[0])
    s = np.linspace(1e-4, 1 + 12 / math.sqrt(df), 400)
    log = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, np.trapezoid(np.exp(log) * range_cdf(q * s), s)))


def tukey(spark: SparkSession, df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Pairwise mean differences with adjusted p-values and intervals; the driver holds one row a group."""
    rows = sorted(group_moments(df, group, value).collect(), key=lambda r: r[group])
    k, dof = len(rows), sum(r.n for r in rows) - len(rows)
    pooled = sum((r.n - 1) * (r["var"] or 0.0) for r in rows) / max(1, dof)
    low, high = 0.0, 100.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if studentized_range_cdf(mid, k, dof) < 1 - alpha else (low, mid)
    out = []
    for a, b in itertools.combinations(rows, 2):
        scale = math.sqrt(pooled / 2 * (1 / a.n + 1 / b.n))
        diff = b["mean"] - a["mean"]
        p = 1 - studentized_range_cdf(abs(diff) / scale, k, dof) if scale > 0 else None
        out.append((str(a[group]), str(b[group]), diff, diff - high * scale, diff + high * scale, p, p is not None and p < alpha))
    return spark.createDataFrame(out, "group_a string, group_b string, mean_diff double, low double, high double, p double, reject boolean")


def rank_summary(long: DataFrame, model: str, rank: str) -> DataFrame:
    """Per model: mean, median, min, max rank."""
    sums = long.groupBy(model).agg(F.avg(rank).alias("mean"), F.min(rank).alias("min"), F.max(rank).alias("max"))
    return with_quantiles(sums, [model], long, rank, {"median": 0.5}).select(model, "mean", "median", "min", "max")


def false_positive_rates(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    negatives = F.count_if(F.col(label) == 0)
    one = df.agg(negatives.alias("n"), *[F.count_if((F.col(label) == 0) & (F.col(score) >= t)).alias(f"_{i}") for i, t in enumerate(thresholds)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_{i}").alias("false_positives"), (F.col(f"_{i}") / F.col("n")).alias("rate")) for i, t in enumerate(thresholds)])))


def place_of(df: DataFrame, key: str, value, score: str) -> DataFrame:
    """Rank of one row from the top and the chance of a random row to be placed as high."""
    p = positions(df, score)
    rank = F.col("total") - F.col("below") - F.col("ties") + 1
    return p.where(F.col(key) == value).select(key, rank.alias("rank"), (rank / F.col("total")).alias("chance"))
