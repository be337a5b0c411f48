"""Folds and models over ``embeddings``: the target is the sum of three coordinates, the class whether that is positive."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M, models as X, ranking as K
from ..operators.lineage import cut, few, scratch
from ..operators.preference import preference_scores
from ..sources.writers import write_groups
from .registry import query, table
from .similarity import similar_pairs


FOLDS = [0, 1, 2, 3]
_TARGET = "(embedding[1]::double + embedding[20]::double + embedding[40]::double)"


def _target():
    return sum((F.get("embedding", i - 1).cast("double") for i in (20, 40)), F.get("embedding", 0).cast("double"))


def _fold():
    """Blocks of twenty ids take turns, so that the ids divisible by 20 are in all folds."""
    return F.floor(F.col("vec_id") / 20).cast("int") % 4


def rows(spark, d):
    e = table(spark, d, "embeddings")
    base = e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (_target() > 0).cast("int").alias("y"), _target().alias("target"), _fold().alias("fold"))
    return X.vectors(base, "embedding").withColumn("features", F.col("embedding"))


def _summary(oof):
    return oof.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"), F.bool_and((F.col("oof") >= 0) & (F.col("oof") <= 1)).alias("in_range"))


_FOLDS = "select (vec_id // 20 % 4)::int as fold, count(*) as n, count(*) filter (" + _TARGET + " > 0) as positives, true as in_range from embeddings group by 1"


@query()
def mdl1_space_folds(spark, d):
    return X.space_folds(table(spark, d, "embeddings"), "vec_id", "embedding", 6, 11)


@query("select vec_id, label, (vec_id % 3)::int as fold from embeddings")
def mdl2_attach_folds(spark, d):
    path, e = scratch(spark, "folds"), table(spark, d, "embeddings").select("vec_id", "label")
    e.select("vec_id", (F.col("vec_id") % 3).cast("int").alias("fold")).write.parquet(path)
    return X.attach_folds(e, spark.read.parquet(path), "vec_id").select("vec_id", "label", "fold")


@query()
def mdl3_sphere_clusters(spark, d):
    return X.sphere_clusters(similar_pairs(spark, d, 6), table(spark, d, "documents"), "doc_id")


@query(
    "with recursive s as (select o_orderpriority, count(*) as n, row_number() over (order by count(*) desc, o_orderpriority) as i from orders group by 1), "
    "g(i, load) as (select 0::bigint, [0::bigint, 0, 0] union all select g.i + 1, list_transform(load, lambda x, j: case when j = list_position(load, list_min(load)) then x + s.n else x end) from g join s on s.i = g.i + 1) "
    "select fold::int as fold, load[fold + 1] as n from (select load from g order by i desc limit 1), (select unnest([0, 1, 2]) as fold)"
)
def mdl4_balanced_folds(spark, d):
    orders = table(spark, d, "orders")
    folds = X.pack_folds(spark, orders, "o_orderpriority", 3)
    return orders.join(F.broadcast(folds) if few(folds, X.BROADCAST_GROUPS) else folds, "o_orderpriority").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


_K, _ROUNDS = 6, 4
_CLUSTERS = (
    "e as materialized (select vec_id, label, embedding[1]::double as score, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings), "
    f"c0 as materialized (select label, dense_rank() over (partition by label order by vec_id) - 1 as cluster, pos, x as c from e qualify cluster < {_K})"
    + "".join(
        f", d{r} as materialized (select vec_id, label, arg_min(cluster, d) as cluster from (select vec_id, e.label, cluster, sum((x - c) * (x - c)) as d from e join c{r} using (label, pos) group by all) group by all)"
        + (f", c{r + 1} as materialized (select label, cluster, pos, coalesce(m, c) as c from c{r} left join (select e.label, cluster, pos, avg(x) as m from d{r} join e using (vec_id) group by all) using (label, cluster, pos))" if r < _ROUNDS else "")
        for r in range(_ROUNDS + 1)
    )
)


@query(f"with {_CLUSTERS} select label, cluster::int as cluster, arg_min(vec_id, -score * 1e6 + vec_id / 1e9) as vec_id from d{_ROUNDS} join (select vec_id, any_value(score) as score from e group by vec_id) using (vec_id) group by all")
def mdl5_cluster_representatives(spark, d):
    """Per label: six clusters and the row of the highest score (first coordinate) of each."""
    e = table(spark, d, "embeddings").withColumn("score", F.get("embedding", 0).cast("double"))
    return X.cluster_representatives(e, "label", "vec_id", "embedding", "score", _K, _ROUNDS, F.col("vec_id"))


@query("select label, least(count(*), 6) as n from embeddings group by label")
def mdl5_representatives_per_group(spark, d):
    return mdl5_cluster_representatives(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("select quality as y, round(case when quality = 1 then (count(*) filter (quality = 0) over ()) / (count(*) filter (quality = 1) over ())::double else 1 end, 6) as weight, doc_id from labels")
def mdl6_class_weights(spark, d):
    out = X.class_weights(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "y")
    return out.select("doc_id", "y", F.round("weight", 6).alias("weight"))


@query(_FOLDS)
def mdl7_rotating_validation(spark, d):
    return _summary(X.cross_validate(rows(spark, d), "vec_id", "y", "fold", FOLDS, rotate=True)[0])


@query("select vec_id, true as scored, (vec_id // 20 % 4) = 3 as is_holdout from embeddings")
def mdl8_oof_and_holdout(spark, d):
    """Folds 0-2 get out-of-fold scores, fold 3 the mean of the fold models."""
    df = rows(spark, d)
    oof, models = X.cross_validate(df, "vec_id", "y", "fold", [0, 1, 2])
    held = X.ensemble_score(df.where("fold = 3"), models)
    both = oof.select("vec_id", F.col("oof").alias("p"), F.lit(False).alias("is_holdout")).unionByName(held.select("vec_id", F.col("mean").alias("p"), F.lit(True).alias("is_holdout")))
    return both.select("vec_id", F.col("p").between(0, 1).alias("scored"), "is_holdout")


@query("select vec_id, true as scored, true as same from embeddings")
def mdl9_every_row_once(spark, d):
    """One score a row by a model that has not seen it; the saved models, loaded, score the same."""
    df, path = rows(spark, d), scratch(spark, "models")
    oof, models = X.cross_validate(df, "vec_id", "y", "fold", FOLDS)
    X.save_models(models, path)
    again = X.ensemble_score(df, X.load_models(path, len(models))).select("vec_id", F.get("members", "fold").alias("again"))
    return oof.join(again, "vec_id").select("vec_id", F.col("oof").between(0, 1).alias("scored"), (F.abs(F.col("oof") - F.col("again")) < 1e-9).alias("same"))


@query("select unnest(['fixed', 'early']) as variant, count(*) as n, true as beats_mean from embeddings")
def mdl10_regression(spark, d):
    """A fixed number of trees, and a fold that decides when to stop: is the error below that of the mean?"""
    df, mean = rows(spark, d), table(spark, d, "embeddings").agg(F.avg(_target())).first()[0]
    out = []
    for name, rotate in (("fixed", False), ("early", True)):
        oof, _ = X.cross_validate(df, "vec_id", "target", "fold", FOLDS, regression=True, rotate=rotate)
        errors = M.regression_errors(oof, "target", "oof", mean).crossJoin(oof.agg(F.count("oof").alias("n")))  # one row each
        out.append(errors.select(F.lit(name).alias("variant"), "n", (F.col("rmse") < F.col("baseline_rmse")).alias("beats_mean")))
    return out[0].unionByName(out[1])


_SETS = {"head": (1, 16), "middle": (17, 16), "tail": (33, 32)}
_BLOCKS = {"none": [], "norm": ["norm"], "signs": ["norm", "signs"]}


def _variants(spark, d):
    """Three feature sets, alone and with one or two further blocks."""
    embedding = F.col("embedding")
    df = rows(spark, d).drop("vector", "features").withColumns({name: F.slice(embedding, *at) for name, at in _SETS.items()})
    squares = F.aggregate(F.transform(embedding, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    df = df.withColumns({"norm": F.sqrt(squares), "signs": F.transform(embedding, lambda x: F.signum(x))})
    return cut(df), {(s, b): [s, *columns] for s in _SETS for b, columns in _BLOCKS.items()}


@query(
    "select features, block, n, true as auroc_in_range, true as ap_above_prevalence from (select unnest(['head', 'middle', 'tail']) as features), (select unnest(['none', 'norm', 'signs']) as block), (select count(*) as n from embeddings)"
)
def mdl11_ablation(spark, d):
    """Feature sets by blocks against one protocol over all folds; SQL can only bound the scores, which the operator gives."""
    df, variants = _variants(spark, d)
    base = df.agg(F.avg("y").alias("base"))
    out = X.ablation(df, "vec_id", "y", "fold", FOLDS, variants).crossJoin(F.broadcast(base))  # one row
    return out.select("features", "block", "n", F.col("auroc").between(0.5, 1).alias("auroc_in_range"), (F.col("ap") >= F.col("base")).alias("ap_above_prevalence"))


@query()
def mdl12_block_effect(spark, d):
    """What a further block changes, over all folds."""
    df, variants = _variants(spark, d)
    scores = X.ablation(df, "vec_id", "y", "fold", FOLDS, {k: v for k, v in variants.items() if k[0] == "head" and k[1] != "norm"})
    wide = scores.groupBy("features").agg(*[F.max(F.when(F.col("block") == b, F.col(m))).alias(f"{m}_{b}") for m in ("auroc", "ap") for b in ("none", "signs")])
    return wide.select("features", (F.col("auroc_signs") - F.col("auroc_none")).alias("auroc_delta"), (F.col("ap_signs") - F.col("ap_none")).alias("ap_delta"))


@query("select unnest(['first', 'rest']) as block, true as in_range, 1.0::double as total")
def mdl13_grouped_importance(spark, d):
    """Shares of feature blocks in the models of all folds, averaged; they add up to 1."""
    df = rows(spark, d).withColumns({"a": F.slice("embedding", 1, 16), "b": F.slice("embedding", 17, 48)})
    df, slices = X.feature_blocks(df, [("first", ["a"]), ("rest", ["b"])], 64)
    _, models = X.cross_validate(X.vectors(df.drop("vector")), "vec_id", "y", "fold", FOLDS)
    shares = [row for m in models for row in X.grouped_importance(m, slices)]
    means = spark.createDataFrame(shares, "block string, importance double, share double").groupBy("block").agg(F.avg("share").alias("share"))
    total = means.agg(F.round(F.sum("share"), 6).alias("total"))
    return means.crossJoin(F.broadcast(total)).select("block", F.col("share").between(0, 1).alias("in_range"), "total")  # one row


def _probes(spark, d):
    df = rows(spark, d)
    return X.probes(df, df.where("vec_id % 20 = 0").select("vec_id"), "vec_id", "target", "embedding", "fold", FOLDS, 1.0, 10)


@query(
    f"with m as (select fold, avg({_TARGET}) as p from (select unnest([0, 1, 2, 3]) as fold) f join embeddings on vec_id // 20 % 4 <> fold group by fold) "
    "select method, n, round(case when method = 'mean' then rmse end, 6) as mean_rmse, method <> 'mean' as beats_mean from (select unnest(['ridge', 'knn', 'mean']) as method), "
    f"(select count(*) as all_rows, count(*) filter (vec_id % 20 = 0) as asked, sqrt(avg(power({_TARGET} - p, 2))) as rmse from embeddings join m on fold = vec_id // 20 % 4), lateral (select case when method = 'knn' then asked else all_rows end as n)"
)
def mdl14_probes(spark, d):
    """Ridge, nearest neighbours (of the ids divisible by 20) and the training mean under the same folds."""
    out = cut(_probes(spark, d))
    errors = out.groupBy("method").agg(F.count("prediction").alias("n"), F.sqrt(F.avg(F.pow(F.col("target") - F.col("prediction"), F.lit(2)))).alias("rmse"))
    base = errors.where("method = 'mean'").select(F.col("rmse").alias("base"))
    flagged = errors.crossJoin(F.broadcast(base))  # one row
    return flagged.select("method", "n", F.round(F.when(F.col("method") == "mean", F.col("rmse")), 6).alias("mean_rmse"), (F.col("rmse") < F.col("base")).alias("beats_mean"))


@query(
    "with e as (select *, " + _TARGET + " as target from embeddings), r as (select a.vec_id, b.target, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as place from e a join e b on a.vec_id // 20 % 4 <> b.vec_id // 20 % 4 where a.vec_id % 20 = 0) "
    "select vec_id, round(avg(target), 6) as prediction from r where place <= 10 group by vec_id"
)
def mdl14_knn_probe(spark, d):
    return _probes(spark, d).where("method = 'knn'").select("vec_id", F.round("prediction", 6).alias("prediction"))


@query("select vec_id, vec_id % 7 = 0 as no_score, case when vec_id % 7 <> 0 then 4 end as members, true as fits from embeddings")
def mdl15_score_new_rows(spark, d):
    """Rows without features stay, with null scores; the mean and deviation of the others are those of four members."""
    df = rows(spark, d)
    _, models = X.cross_validate(df, "vec_id", "y", "fold", FOLDS)
    new = df.withColumn("vector", F.when(F.col("vec_id") % 7 != 0, F.col("vector")))
    out = X.ensemble_score(new, models)
    inside = (F.col("mean") >= F.array_min("members") - 1e-9) & (F.col("mean") <= F.array_max("members") + 1e-9) & (F.col("std") >= 0)
    return out.select("vec_id", F.col("mean").isNull().alias("no_score"), F.when(F.col("members").isNotNull(), F.size("members")).alias("members"), F.coalesce(inside, F.lit(True)).alias("fits"))


_ORDERED = "p as (select a.vec_id as a, b.vec_id as b, a.label - b.label >= 1 as y from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id // 20 % 4 = b.vec_id // 20 % 4 and a.vec_id <> b.vec_id)"
#: Parts that the rows of a fold are dealt into, each of which meets all queries of the fold.
_PARTS = 32
#: Queries up to which they go to all rows.
_FEW_QUERIES = 100_000


def _ordered_pairs(spark, d):
    """Ordered pairs i <> j within a fold: the stated queries (ids divisible by 20) against all rows, in blocks."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), _fold().alias("fold"))
    a, b = e.where("vec_id % 20 = 0").toDF("a", "la", "va", "fold"), e.toDF("b", "lb", "vb", "fold")
    if few(a, _FEW_QUERIES):
        # Every task has as many rows, which meet the queries of their folds.
        pairs = b.repartition(_PARTS * len(FOLDS)).join(F.broadcast(a), "fold")
    else:
        a, b = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)))), b.withColumn("part", F.pmod(F.hash("b"), F.lit(_PARTS)))
        pairs = a.join(b, ["fold", "part"])
    return pairs.where("a <> b").withColumn("y", F.col("la") - F.col("lb") >= 1)


@query(f"with {_ORDERED} select a, b, y from p")
def jon11_ordered_pairs(spark, d):
    return _ordered_pairs(spark, d).select("a", "b", "y")


@query("select a.vec_id as a, round(avg((a.label - b.label >= 1)::int), 6) as score from embeddings a join embeddings b on a.vec_id // 20 % 4 = b.vec_id // 20 % 4 and a.vec_id <> b.vec_id group by a.vec_id")
def win13_pair_to_row_score(spark, d):
    """Every row's share of its fold that it beats by 1 at least, from the fold's histogram of labels instead of pairs."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), "label", _fold().alias("fold"))
    counts = e.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
    fold = Window.partitionBy("fold")
    # One row a fold and label.
    beaten = counts.select("fold", "label", F.coalesce(F.sum("n").over(fold.orderBy("label").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("beaten"), (F.sum("n").over(fold) - 1).alias("others"))
    return e.join(beaten, ["fold", "label"]).where("others > 0").select("a", F.round(F.col("beaten") / F.col("others"), 6).alias("score"))


@query()
def mdl16_pairwise_preference(spark, d):
    """Difference features of ordered pairs, balanced classes, a model, and the mean chance to win as each row's score."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", _fold().alias("fold"), (F.floor(F.col("vec_id") / 80) % 4).cast("int").alias("model"))
    # A row is scored by the model that has not seen it as the first of a pair.
    per_row = preference_scores(e, "vec_id", "label", "embedding", "fold", "model", F.col("vec_id") % 20 == 0, FOLDS, X.TREES, 3)
    return M.correlations(per_row, "score", "label")


@query()
def mdl17_parameter_search(spark, d):
    """Cross-validation over fixed folds and a seeded random grid, by area under the precision-recall curve."""
    import random

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    lr = LogisticRegression(featuresCol="vector", labelCol="y", maxIter=10)
    rng = random.Random(5)
    grid = ParamGridBuilder().addGrid(lr.regParam, sorted(10 ** rng.uniform(-4, 0) for _ in range(4))).addGrid(lr.elasticNetParam, [0.0, rng.uniform(0.1, 1.0)]).build()
    # Without bins the area is that of all different scores.
    exact = BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderPR", numBins=0)
    search = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=exact, numFolds=len(FOLDS), foldCol="fold", parallelism=4)
    fitted = search.fit(cut(rows(spark, d)))
    best = fitted.avgMetrics.index(max(fitted.avgMetrics))
    return spark.createDataFrame([(p[lr.regParam], p[lr.elasticNetParam], float(m), i == best) for i, (p, m) in enumerate(zip(grid, fitted.avgMetrics))], "reg double, mix double, pr_auc double, best boolean")


def _funnel(spark, d):
    """Score, keep the better half, route to the nearest of three references, cluster, select, write by group, read back."""
    df = rows(spark, d)
    _, models = X.cross_validate(df, "vec_id", "y", "fold", FOLDS)
    scored = cut(X.ensemble_score(df, models).select("vec_id", "embedding", "mean"))
    best = K.top_or_threshold(scored, "mean", "vec_id", n=max(6, scored.count() // 2))
    refs = {r.vec_id: list(r.embedding) for r in df.where("vec_id in (1, 2, 3)").select("vec_id", "embedding").collect()}  # three rows
    dots = [F.struct(F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, v)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("sim"), F.lit(-i).alias("i")) for i, v in sorted(refs.items())]
    routed = best.withColumn("grp", F.when(F.greatest(*dots)["sim"] > 0, F.concat(F.lit("g"), (-F.greatest(*dots)["i"]).cast("string"))).otherwise("DEFAULT"))
    routed, path = cut(routed), scratch(spark, "picks")
    picks = X.cluster_representatives(routed, "grp", "vec_id", "embedding", "mean", 3)
    write_groups(picks.join(routed.select("vec_id", "mean"), "vec_id"), "grp", path)
    return routed, spark.read.parquet(path)


@query()
def mdl19_funnel(spark, d):
    return _funnel(spark, d)[1].select("grp", "cluster", "vec_id", F.round("mean", 6).alias("mean"))


@query("select greatest(6, count(*) // 2) as n_kept, true as picks_fit from embeddings")
def mdl19_funnel_counts(spark, d):
    """Half of the rows pass, and each group gives one row a cluster: three, or all it has."""
    routed, picks = _funnel(spark, d)
    wanted = routed.groupBy("grp").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("wanted"), F.count(F.lit(1)).alias("n"))
    got = picks.groupBy("grp").agg(F.count_distinct("cluster").alias("got"), F.count(F.lit(1)).alias("rows"))
    both = wanted.join(got, "grp", "left")
    return both.agg(F.sum("n").alias("n_kept"), F.bool_and((F.col("wanted") == F.col("got")) & (F.col("wanted") == F.col("rows"))).alias("picks_fit"))
