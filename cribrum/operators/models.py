"""Folds, ensembles and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut, few
from .metrics import auroc, average_precision
from .ranking import best_per_key, rank_norms
from .similarity import nearest_rows

#: Groups up to which their centres are broadcast.
BROADCAST_GROUPS = 10_000
#: Boosted trees of a model, wherever there are no others asked for.
TREES = 20


def feature_blocks(df: DataFrame, blocks: list[tuple[str, list[str]]], width: int | None = None) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """Adds ``features`` (array), the blocks' columns one after another, and gives each block's (name, start, end).

    Columns are numbers or arrays of numbers; a null anywhere, or arrays that
    differ in length, fail the job.
    """
    columns = [c for _, names in blocks for c in names]
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    first = df.select(*[F.size(c).alias(c) if kinds[c] == "array" else F.lit(1).alias(c) for c in columns]).first()
    slices, at = [], 0
    for name, names in blocks:
        end = at + sum(first[c] for c in names) if first else at
        slices.append((name, at, end))
        at = end
    if width is not None and at != width:
        raise ValueError(f"{at} features, {width} expected")
    parts = [F.col(c).cast("array<double>") if kinds[c] == "array" else F.array(F.col(c).cast("double")) for c in columns]
    whole = F.concat(*parts)
    solid = F.when((F.size(whole) == at) & ~F.exists(whole, lambda x: x.isNull()), whole).otherwise(F.raise_error(F.lit("a feature is missing")).cast("array<double>"))
    return df.withColumn("features", solid), slices


def vectors(df: DataFrame, array: str = "features", name: str = "vector") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(array).cast("array<double>")))


def space_folds(df: DataFrame, key: str, array: str, k: int, seed: int) -> DataFrame:
    """key, fold, pc_1, pc_2: k-means clusters of a two-dimensional projection; an empty fold is an error."""
    rows = vectors(df.select(key, array), array)
    # Clusters are sought over the plane again and again, and folds are counted: it is computed once.
    flat = cut(PCA(k=2, inputCol="vector", outputCol="plane").fit(rows).transform(rows).select(key, "plane"))
    plane = vector_to_array("plane")
    fitted = KMeans(k=k, seed=seed, featuresCol="plane", predictionCol="fold").fit(flat)
    if min(fitted.summary.clusterSizes) == 0:
        raise ValueError("a fold is empty")
    return fitted.transform(flat).select(key, "fold", plane[0].alias("pc_1"), plane[1].alias("pc_2"))


def attach_folds(df: DataFrame, folds: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """The rows with their fold, joined by key; an error if a row has none or a key has several."""
    out = cut(df.join(folds.select(key, fold), key, "left"))
    n, missing = out.agg(F.count(F.lit(1)), F.count_if(F.col(fold).isNull())).first()
    if missing or n != df.count():
        raise ValueError(f"{missing} rows have no fold, {n} rows with folds")
    return out


def _nearest_centre(rows: DataFrame, centres: DataFrame, few_groups: bool) -> DataFrame:
    """Adds ``cluster``, the nearest centre of the row's group (the lowest among equals); centres: _g, centres (array of cluster, centre)."""
    known = F.broadcast(centres) if few_groups else centres

    def squares(c: Column) -> Column:
        return F.aggregate(F.zip_with("_x", c["centre"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)

    nearest = F.array_min(F.transform("centres", lambda c: F.struct(squares(c).alias("d"), c["cluster"].alias("cluster"))))
    return rows.join(known, F.col("_group").eqNullSafe(F.col("_g"))).withColumn("cluster", nearest["cluster"]).drop("_g", "centres")


def group_clusters(df: DataFrame, group: str, key: str, array: str, k: int, rounds: int, start: Column) -> DataFrame:
    """group, key, cluster: k-means of each group by itself, of all groups at once.

    A group starts from its first ``k`` rows by ``start``, then key; each round assigns
    all rows to the nearest centre of their group, the lowest among equals, and moves
    each centre to the mean of its rows; centres without rows stay.  It ends after
    ``rounds`` rounds or where no centre moves: so there are as many jobs as
    rounds, however many groups.  In groups of up to ``k`` rows each row is a cluster
    of its own.  Null is a group like any other; rows without a vector have no cluster.
    """
    rows = cut(df.where(F.col(array).isNotNull()).select(F.col(group).alias("_group"), F.col(key).alias("_key"), F.col(array).cast("array<double>").alias("_x"), start.alias("_start")))
    numbered = rows.withColumn("cluster", F.row_number().over(Window.partitionBy("_group").orderBy("_start", "_key")) - 1).where(F.col("cluster") < k)
    first = cut(numbered.select("_group", "_key", "_x", "cluster"))
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    small = F.broadcast(sizes.where(F.col("_n") <= k)) if few(sizes, BROADCAST_GROUPS) else sizes.where(F.col("_n") <= k)
    same = rows["_group"].eqNullSafe(F.col("_g"))
    large = cut(rows.join(small.select(F.col("_group").alias("_g")), same, "left_anti"))
    lone = first.join(small.select(F.col("_group").alias("_g")), first["_group"].eqNullSafe(F.col("_g")), "left_semi")
    few_groups = few(sizes, BROADCAST_GROUPS)

    def by_group(centres: DataFrame) -> DataFrame:
        return cut(centres.groupBy(F.col("_group").alias("_g")).agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("centres")))

    centres = by_group(first.select("_group", "cluster", F.col("_x").alias("centre")))
    for _ in range(rounds):
        placed = _nearest_centre(large, centres, few_groups)
        moved = placed.groupBy("_group", "cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("_x"))).alias("mean")).toDF("_h", "_c", "mean")
        old = centres.select(F.col("_g").alias("_group"), F.inline("centres"))
        new = old.join(moved, F.col("_group").eqNullSafe(F.col("_h")) & (F.col("cluster") == F.col("_c")), "left")
        new = cut(new.select("_group", "cluster", F.coalesce("mean", "centre").alias("centre"), (F.col("mean").isNotNull() & (F.col("mean") != F.col("centre"))).alias("moved")))
        centres = by_group(new)
        if new.where("moved").isEmpty():
            break
    out = _nearest_centre(large, centres, few_groups).select("_group", "_key", "cluster").unionByName(lone.select("_group", "_key", "cluster"))
    return out.select(F.col("_group").alias(group), F.col("_key").alias(key), F.col("cluster").cast("int").alias("cluster"))


def cluster_representatives(df: DataFrame, group: str, key: str, array: str, score: str, k: int, rounds: int = 10, start: Column | None = None) -> DataFrame:
    """Per group: its rows in ``k`` clusters (``group_clusters``), and of each the row of the highest score (the least key among equals); all rows of groups of up to ``k``.

    Columns group, cluster, key.  Without ``start`` the order of the first rows is that of a hash of the key.
    """
    placed = group_clusters(df, group, key, array, k, rounds, F.xxhash64(F.col(key)) if start is None else start)
    scored = placed.join(df.select(F.col(key).alias("_key"), F.col(score).alias("_score")), F.col(key) == F.col("_key"))
    return best_per_key(scored, [group, "cluster"], [F.desc("_score"), F.asc(key)]).select(group, "cluster", key)


def sphere_clusters(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, cluster: leaders take all that is near them; the most connected unassigned row of its neighbourhood leads.

    ``pairs``: i, j at most the radius apart.  A row becomes a leader when its
    (degree, -key) is the highest among its unassigned neighbours; its unassigned
    neighbours join the best of the leaders beside them.
    """
    both = cut(pairs.select("i", "j").union(pairs.select("j", "i")).distinct().toDF("a", "b"))
    degree = both.groupBy(F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("degree"))
    waiting = cut(nodes.select(F.col(key).alias("n")).join(degree, "n", "left").select("n", F.struct(F.coalesce("degree", F.lit(0)).alias("d"), (-F.col("n")).alias("m")).alias("rank")))
    done: list[DataFrame] = []
    while not waiting.isEmpty():
        rank = waiting.select(F.col("n").alias("b"), F.col("rank").alias("other"))
        live = both.join(waiting.select(F.col("n").alias("a")), "a", "left_semi").join(rank, "b")
        rival = live.groupBy(F.col("a").alias("n")).agg(F.max("other").alias("other"))
        leaders = cut(waiting.join(rival, "n", "left").where(F.col("other").isNull() | (F.col("rank") > F.col("other"))).select("n", "rank"))
        joined = live.select("a", "b").join(leaders.select(F.col("n").alias("b"), "rank"), "b").groupBy(F.col("a").alias("n")).agg(F.max(F.struct("rank", F.col("b").alias("leader")))["leader"].alias("cluster"))
        now = leaders.select("n", F.col("n").alias("cluster")).union(joined.select("n", "cluster"))
        done.append(cut(now))
        waiting = cut(waiting.join(done[-1].select("n"), "n", "left_anti"))
    return reduce(DataFrame.union, done).withColumnRenamed("n", key) if done else nodes.select(key, F.col(key).alias("cluster"))


def pack_folds(spark: SparkSession, clustered: DataFrame, cluster: str, k: int) -> DataFrame:
    """cluster, fold: clusters from the largest down, each into the fold that is smallest so far.

    Sizes are counted in Spark; the driver holds one row a cluster.
    """
    sizes = sorted(((r["count"], r[cluster]) for r in clustered.groupBy(cluster).count().collect()), key=lambda x: (-x[0], x[1]))
    load, rows = [0] * k, []
    for n, name in sizes:
        fold = min(range(k), key=lambda f: (load[f], f))
        load[fold] += n
        rows.append((name, fold))
    return spark.createDataFrame(rows, f"{cluster} {clustered.schema[cluster].dataType.simpleString()}, fold int")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: negatives over positives for positives, 1 for negatives."""
    counts = df.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("_r"))
    return df.crossJoin(F.broadcast(counts)).withColumn("weight", F.when(F.col(label) == 1, F.col("_r")).otherwise(1.0)).drop("_r")  # one row


def save_models(models: list[Model], path: str) -> None:
    """Fold models in numbered folders; an error if there are any already."""
    for i, m in enumerate(models):
        m.save(f"{path}/model_{i}")


def load_models(path: str, n: int, regression: bool = False) -> list[Model]:
    kind = GBTRegressionModel if regression else GBTClassificationModel
    return [kind.load(f"{path}/model_{i}") for i in range(n)]


def _trees(regression: bool, label: str, trees: int, seed: int, validate: bool):
    kind = GBTRegressor if regression else GBTClassifier
    model = kind(featuresCol="vector", labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.2, seed=seed)
    if not regression:
        model = model.setWeightCol("weight")
    return model.setValidationIndicatorCol("is_val") if validate else model


def _score(model: Model, df: DataFrame, regression: bool, name: str) -> DataFrame:
    p = F.col("prediction") if regression else vector_to_array("probability")[1]
    return model.transform(df).withColumn(name, p).drop("prediction", "rawPrediction", "probability")


def cross_validate(df: DataFrame, key: str, label: str, fold: str, folds: list[int], trees: int = TREES, seed: int = 7, rotate: bool = False, regression: bool = False) -> tuple[DataFrame, list[Model]]:
    """Out-of-fold scores (key, label, fold, oof), one for every row of the folds, and the fold models.

    Model i never sees fold i.  With ``rotate`` the next fold decides when to
    stop adding trees.
    """
    # The trainer goes over its rows again and again.
    rows = cut(df if regression else class_weights(df, label))

    def fit(i: int) -> Model:
        train = rows.where(F.col(fold).isin([f for j, f in enumerate(folds) if j != i]))
        if rotate:
            train = train.withColumn("is_val", F.col(fold) == folds[(i + 1) % len(folds)])
        return _trees(regression, label, trees, seed, rotate).fit(train)

    # Folds are fitted at the same time: the many small jobs of one leave cores idle.
    with ThreadPoolExecutor(len(folds)) as pool:
        models = list(pool.map(fit, range(len(folds))))
    parts = [_score(m, rows.where(F.col(fold) == k), regression, "oof").select(key, label, fold, "oof") for m, k in zip(models, folds)]
    return reduce(DataFrame.unionByName, parts), models


def ensemble_score(df: DataFrame, models: list[Model], regression: bool = False) -> DataFrame:
    """Adds members (array), mean and std over the models; rows without a vector keep nulls."""
    good, bad = df.where("vector is not null"), df.where("vector is null")
    for i, m in enumerate(models):
        good = _score(m, good, regression, f"_m{i}")
    names = [f"_m{i}" for i in range(len(models))]
    good = good.withColumn("members", F.array(*names)).drop(*names)
    mean = F.aggregate("members", F.lit(0.0), lambda s, x: s + x) / len(models)
    spread = F.sqrt(F.aggregate("members", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / len(models))
    return good.withColumn("mean", mean).withColumn("std", spread).unionByName(bad, allowMissingColumns=True)


def rank_ensemble(df: DataFrame, scores: list[str], name: str) -> DataFrame:
    """Adds the mean of the normalised ranks of several scores."""
    out = rank_norms(df, {s: f"_n_{s}" for s in scores})
    return out.withColumn(name, sum((F.col(f"_n_{s}") for s in scores), F.lit(0.0)) / len(scores)).drop(*[f"_n_{s}" for s in scores])


def grouped_importance(model: Model, slices: list[tuple[str, int, int]]) -> list[tuple[str, float, float]]:
    """(block, importance, share) of a tree model, over its feature slices."""
    values = model.featureImportances.toArray()
    total = float(values.sum()) or 1.0
    return [(name, float(values[a:b].sum()), float(values[a:b].sum()) / total) for name, a, b in slices]


def ablation(df: DataFrame, key: str, label: str, fold: str, folds: list[int], variants: dict[tuple[str, str], list[str]], trees: int = TREES, parallel: int = 3) -> DataFrame:
    """Rows (features, block, n, auroc, ap): the same folds and models for each variant's columns (arrays or numbers).

    ``parallel`` variants are fitted at a time: the jobs of one leave cores idle.
    """

    def one(variant: tuple[tuple[str, str], list[str]]) -> DataFrame:
        (features, block), columns = variant
        rows, _ = feature_blocks(df, [("all", columns)])
        oof = cut(cross_validate(vectors(rows), key, label, fold, folds, trees=trees)[0])
        scores = auroc(oof, label, "oof").crossJoin(average_precision(oof, label, "oof")).crossJoin(oof.agg(F.count("oof").alias("n")))  # one row each
        return cut(scores.select(F.lit(features).alias("features"), F.lit(block).alias("block"), "n", "auroc", "ap"))

    with ThreadPoolExecutor(parallel) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, variants.items()))


def probes(df: DataFrame, queries: DataFrame, key: str, target: str, array: str, fold: str, folds: list[int], alpha: float, k: int) -> DataFrame:
    """Rows (method, key, target, prediction) under the same folds: ridge regression and the training mean for all rows, the mean of the k nearest training rows for the queries."""
    rows = cut(vectors(df.select(key, target, array, fold), array))
    parts = []
    for f in folds:
        train, test = rows.where(F.col(fold) != f), rows.where(F.col(fold) == f)
        ridge = linear_probe(train, target, alpha).transform(test).select(F.lit("ridge").alias("method"), key, target, "prediction")
        mean = train.agg(F.avg(target).alias("prediction"))
        flat = test.crossJoin(F.broadcast(mean)).select(F.lit("mean").alias("method"), key, target, "prediction")  # one row
        asked = queries.join(test.select(key, array, target), key)
        near = nearest_rows(train, asked, key, array, k).join(train.select(F.col(key).alias("neighbour"), F.col(target).alias("_t")), "neighbour")
        knn = near.groupBy("query").agg(F.avg("_t").alias("prediction")).join(asked.select(F.col(key).alias("query"), target), "query")
        parts += [ridge, flat, knn.select(F.lit("knn").alias("method"), F.col("query").alias(key), target, "prediction")]
    return reduce(DataFrame.unionByName, parts)


def linear_probe(df: DataFrame, label: str, alpha: float) -> Model:
    """Ridge regression whose penalty is alpha over the number of rows."""
    n = df.count()
    return LinearRegression(featuresCol="vector", labelCol=label, elasticNetParam=0.0, regParam=alpha / max(1, n), standardization=False).fit(df)


def per_group(df: DataFrame, group: str, f: Callable, schema: str) -> DataFrame:
    """A user's function over the rows of each group, as a pandas DataFrame."""
    return df.groupBy(group).applyInPandas(f, schema)


