"""Metrics over ``labels.quality`` and three scores made of columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M, ranking as K
from .registry import query, table


def predictions(spark, d):
    """doc_id, y and the scores m0 (by length), m1 (nearly arbitrary), m2 (many ties)."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").select(
        "doc_id", "y", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("m0"), ((F.col("doc_id") * 7919 % 1009) / 1009.0).alias("m1"), (F.least(F.floor(F.col("n_chars") / 500.0), F.lit(9)) / 10.0).alias("m2")
    )


_P = (
    "p as (select doc_id, quality as y, n_chars / (n_chars + 2000.0::double) as m0, (doc_id * 7919 % 1009) / 1009.0::double as m1, least(floor(n_chars / 500.0::double), 9) / 10.0::double as m2 "
    "from documents join labels using (doc_id))"
)
_C = (
    "g as (select m2 as threshold, count(*) as n, sum(y) as pos from p group by 1), t as (select sum(pos) as pp, sum(n) - sum(pos) as nn from g), "
    "c as (select threshold, n, pos, sum(n) over (order by threshold desc) as cum_n, sum(pos) over (order by threshold desc) as cum_pos, pp, nn from g, t)"
)


def _round(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("with " + _P + ", r as (select y, m2, rank() over (order by m2) + (count(*) over (partition by m2) - 1) / 2.0 as r from p) select round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 6) as auroc from r")
def met1_auroc(spark, d):
    return _round(M.auroc(predictions(spark, d), "y", "m2"), "auroc")


@query(f"with {_P}, {_C} select round(sum(pos / pp * cum_pos / cum_n), 6) as ap from c")
def met2_average_precision(spark, d):
    return _round(M.average_precision(predictions(spark, d), "y", "m2"), "ap")


@query(f"with {_P}, {_C} select round(sum(pos / pp * (cum_pos / cum_n + case when cum_n > n then (cum_pos - pos) / (cum_n - n) else 1 end) / 2), 6) as pr_auc from c")
def met3_pr_trapezoid(spark, d):
    return _round(M.pr_trapezoid(predictions(spark, d), "y", "m2"), "pr_auc")


@query(f"with {_P}, {_C} select threshold, round((cum_n - cum_pos) / nn, 6) as fpr, round(cum_pos / pp, 6) as tpr, round(cum_pos / cum_n, 6) as precision from c")
def met4_curve_points(spark, d):
    return _round(M.points(predictions(spark, d), "y", "m2").select("threshold", "fpr", "tpr", "precision"), "fpr", "tpr", "precision")


@query(f"with {_P}, {_C} select threshold, round(2 * cum_pos / (cum_n + pp), 6) as f1, cum_pos::bigint as tp, (cum_n - cum_pos)::bigint as fp, (pp - cum_pos)::bigint as fn, (nn - cum_n + cum_pos)::bigint as tn from c order by 2 * cum_pos / (cum_n + pp) desc, threshold desc limit 1")
def met5_best_f1(spark, d):
    return _round(M.best_f1(predictions(spark, d), "y", "m2").select("threshold", "f1", "tp", "fp", "fn", "tn"), "f1")


_Q = "q as (select count(*) filter (y = 1 and m0 >= 0.5)::double as tp, count(*) filter (y = 0 and m0 >= 0.5)::double as fp, count(*) filter (y = 1 and m0 < 0.5)::double as fn, count(*) filter (y = 0 and m0 < 0.5)::double as tn from p)"


@query(f"with {_P}, {_Q} select round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy from q")
def met6_threshold_metrics(spark, d):
    names = ["precision", "recall", "f1", "balanced_accuracy"]
    return _round(M.confusion(predictions(spark, d), "y", "m0").select(*names), *names)


@query(f"with {_P}, {_Q} select round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc from q")
def met7_mcc(spark, d):
    return _round(M.confusion(predictions(spark, d), "y", "m0").select("mcc"), "mcc")


@query(f"with {_P} select round(avg(power(m1 - y, 2)), 6) as brier, round(avg(y) * (1 - avg(y)), 6) as baseline, count(*) as n from p")
def met8_brier(spark, d):
    return _round(M.brier(predictions(spark, d), "y", "m1"), "brier", "baseline")


@query(f"with {_P} select doc_id, round(power(m1 - y, 2), 8) as err from p")
def scl11_squared_error(spark, d):
    return predictions(spark, d).select("doc_id", F.round(S.squared_error(F.col("m1"), F.col("y")), 8).alias("err"))


@query(f"with {_P}, r as (select y, row_number() over (order by m1 desc, doc_id) as rn from p) select k, count(*) filter (y = 1 and rn <= k) as hits, round(count(*) filter (y = 1 and rn <= k) / k, 6) as precision, round(k * avg(y), 6) as by_chance from r, (select unnest([5, 10, 20, 30]) as k) group by k")
def met9_top_k_precision(spark, d):
    out = M.top_precision(predictions(spark, d), "y", "m1", "doc_id", [5, 10, 20, 30])
    return _round(out, "precision", "by_chance").withColumn("hits", F.col("hits").cast("long"))


@query("with e as (select l_extendedprice as y, l_quantity * 1500.0 as p from lineitem) select round(avg(power(y - p, 2)), 4) as mse, round(sqrt(avg(power(y - p, 2))), 4) as rmse, round(avg(abs(y - p)), 4) as mae, round(1 - avg(power(y - p, 2)) / var_pop(y), 6) as r2, round(sqrt(avg(power(y - 30000, 2))), 4) as baseline_rmse from e")
def met10_regression_errors(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    out = M.regression_errors(rows, "y", "p", 30000.0)
    return _round(_round(out, "mse", "rmse", "mae", "baseline_rmse", digits=4), "r2")


@query("with r as (select l_quantity as a, l_extendedprice as b, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as ra, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as rb from lineitem) select round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman, count(*) as n from r")
def met11_correlations(spark, d):
    return _round(M.correlations(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice"), "pearson", "spearman")


@query("with p as (select x.user_id, sign(x.value - y.value) as sa, sign(x.event_id % 17 - y.event_id % 17) as sb from events x join events y on x.user_id = y.user_id and x.event_id < y.event_id) select user_id, round(sum(sa * sb) / sqrt(sum(abs(sa)) * sum(abs(sb))), 6) as tau_b from p group by 1")
def met11_kendall(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_id") % 17).alias("m"))
    return _round(M.kendall_by_group(rows, "user_id", "event_id", "value", "m"), "tau_b")


@query(
    "with t as (select o_totalprice as a, o_custkey % 50 as b, count(*) as c from orders group by all), p as (select sum(sign(x.a - y.a) * sign(x.b - y.b) * x.c * y.c) as s, sum((x.a <> y.a)::int * x.c * y.c) as na, sum((x.b <> y.b)::int * x.c * y.c) as nb from t x join t y on x.a < y.a or x.a = y.a and x.b < y.b) "
    "select round(s / (sqrt(na) * sqrt(nb)), 8) as tau_b, (select count(*) from orders) as n from p"
)
def met11_kendall_table(spark, d):
    """Of a whole table, by counting inversions."""
    orders = table(spark, d, "orders").select("o_totalprice", (F.col("o_custkey") % 50).alias("b"))
    return _round(M.kendall(orders, "o_totalprice", "b"), "tau_b", digits=8)


def _wilcoxon_sql(a, b):
    return (
        f"select '{a}' as model_a, '{b}' as model_b, count(*) as n, round(least(coalesce(sum(r) filter (d > 0), 0), coalesce(sum(r) filter (d < 0), 0)), 4) as w "
        f"from (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from (select power({a} - y, 2) - power({b} - y, 2) as d from p) where d <> 0)"
    )


@query(f"with {_P} " + " union all ".join(_wilcoxon_sql(a, b) for a, b in (("m0", "m1"), ("m0", "m2"), ("m1", "m2"))))
def met12_signed_rank_statistic(spark, d):
    return _errors_compared(spark, d).select("model_a", "model_b", "n", F.round("w", 4).alias("w"))


def _errors_compared(spark, d):
    p = predictions(spark, d)
    errors = p.select("doc_id", *[F.pow(F.col(m) - F.col("y"), F.lit(2.0)).alias(m) for m in ("m0", "m1", "m2")])
    return M.compare_models(spark, errors, ["m0", "m1", "m2"])


@query()
def met12_signed_rank_test(spark, d):
    return _errors_compared(spark, d)


@query("with g as (select event_type as g, avg(value) as mean from events group by 1) select a.g as group_a, b.g as group_b, round(b.mean - a.mean, 6) as mean_diff from g a join g b on a.g < b.g")
def met13_pairwise_means(spark, d):
    return M.tukey(spark, table(spark, d, "events"), "event_type", "value").select("group_a", "group_b", F.round("mean_diff", 6).alias("mean_diff"))


@query()
def met13_tukey(spark, d):
    return M.tukey(spark, table(spark, d, "events"), "event_type", "value")


_FR = ", ".join(f"(select * from (select y, '{m}' as model, (rank() over (order by {m} desc) - 1 + 0.5 * (count(*) over (partition by {m}) - 1)) / greatest(count(*) over () - 1, 1) as r from p) where y = 1)" for m in ("m0", "m1", "m2")).replace("), (", ") union all (")


def _positive_ranks(spark, d):
    p = K.fractional_ranks(predictions(spark, d), {m: f"r_{m}" for m in ("m0", "m1", "m2")})
    return p.where("y = 1").select("doc_id", *[F.col(f"r_{m}").alias(m) for m in ("m0", "m1", "m2")]).unpivot("doc_id", ["m0", "m1", "m2"], "model", "r")


@query(f"with {_P} select model, round(avg(r), 6) as mean, round(median(r), 6) as median, round(min(r), 6) as min, round(max(r), 6) as max from ({_FR}) group by model")
def met14_ensemble_summary(spark, d):
    return _round(M.rank_summary(_positive_ranks(spark, d), "model", "r"), "mean", "median", "min", "max")


@query(f"with {_P}, s as (select model, avg(r) as mean, median(r) as median from ({_FR}) group by model) select arg_min(model, mean) as best_by_mean, arg_min(model, median) as best_by_median from s")
def met14_best_models(spark, d):
    return M.rank_summary(_positive_ranks(spark, d), "model", "r").agg(F.min_by("model", "mean").alias("best_by_mean"), F.min_by("model", "median").alias("best_by_median"))


@query(f"with {_P} select threshold::double as threshold, count(*) filter (y = 0 and m1 >= threshold) as false_positives, round(count(*) filter (y = 0 and m1 >= threshold) / count(*) filter (y = 0), 6) as rate from p, (select unnest([0.1, 0.2, 0.3, 0.5]) as threshold) group by threshold")
def met16_false_positive_rates(spark, d):
    return _round(M.false_positive_rates(predictions(spark, d), "y", "m1", [0.1, 0.2, 0.3, 0.5]), "rate")


@query(f"with {_P}, r as (select doc_id, y, rank() over (order by m1 desc) as rank, count(*) over () as n from p) select doc_id, rank, round(rank / n, 6) as chance from r where doc_id = (select min(doc_id) from p where y = 1)")
def met17_single_positive(spark, d):
    p = predictions(spark, d)
    first = p.where("y = 1").agg(F.min("doc_id")).first()[0]
    return _round(M.place_of(p, "doc_id", first, "m1").withColumn("rank", F.col("rank").cast("long")), "chance")
