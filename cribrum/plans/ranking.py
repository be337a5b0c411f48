"""Ranks, top-k, sampling and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ranking as K
from .metrics import _P, predictions
from .registry import query, table


@query("select l_orderkey, l_linenumber, round((rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0) / count(*) over (), 8) as rn from lineitem")
def win1_rank_norm(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return K.rank_norm(rows, "l_extendedprice", "rn").select("l_orderkey", "l_linenumber", F.round("rn", 8).alias("rn"))


@query("select l_orderkey, l_linenumber, rank() over (order by l_quantity desc) + (count(*) over (partition by l_quantity) - 1) / 2.0::double as r from lineitem")
def win2_average_rank(spark, d):
    return K.average_rank_desc(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "r").drop("l_quantity")


@query("select event_id, row_number() over (order by s desc nulls last, event_id) as place from (select event_id, case when event_id % 10 = 0 then null else value end as s from events)")
def win3_ordinal_rank(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("s"))
    return K.ordinal_rank(rows, "s", "event_id", "place").select("event_id", "place")


def _norm(m):
    return f"(rank() over (order by {m}) + (count(*) over (partition by {m}) - 1) / 2.0) / count(*) over ()"


@query(f"with {_P} select doc_id, round(({_norm('m0')} + {_norm('m1')} + {_norm('m2')}) / 3, 6) as ensemble from p")
def win4_ensemble_rank(spark, d):
    p = K.rank_norms(predictions(spark, d), {m: f"n_{m}" for m in ("m0", "m1", "m2")})
    return p.select("doc_id", F.round((F.col("n_m0") + F.col("n_m1") + F.col("n_m2")) / 3, 6).alias("ensemble"))


@query(f"with {_P}, r as (select doc_id, y, (rank() over (order by m2 desc) - 1 + 0.5 * (count(*) over (partition by m2) - 1)) / greatest(count(*) over () - 1, 1) as r from p) select doc_id, round(r, 8) as r from r where y = 1")
def win5_fractional_rank(spark, d):
    return K.fractional_rank(predictions(spark, d), "m2", "r").where("y = 1").select("doc_id", F.round("r", 8).alias("r"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn = 1")
def win6_best_per_key(spark, d):
    return K.best_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("select p_brand, p_type, p_partkey from (select *, row_number() over (partition by p_brand, p_type order by p_retailprice desc, p_partkey) as rn from part) where rn = 1")
def win10_cluster_representative(spark, d):
    return K.best_per_key(table(spark, d, "part"), ["p_brand", "p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_type", "p_partkey")


@query("select user_id, round(avg(value), 6) as top5 from (select *, row_number() over (partition by user_id order by value desc) as rn from events) where rn <= 5 group by 1")
def win11_top_k_mean(spark, d):
    return K.top_k_mean(table(spark, d, "events"), "user_id", "value", 5, "top5").withColumn("top5", F.round("top5", 6))


@query("select event_id, max(value) over (partition by user_id order by event_id rows unbounded preceding) as best from events")
def win12_running_best(spark, d):
    return K.running_best(table(spark, d, "events"), "user_id", "event_id", "value", "best").select("event_id", "best")


@query("select user_id, event_id, round((value - avg(value) over w) / stddev_samp(value) over w, 6) as z, round(percent_rank() over (partition by user_id order by value), 6) as pr from events window w as (partition by user_id)")
def win15_within_group_scores(spark, d):
    w = Window.partitionBy("user_id")
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    return table(spark, d, "events").select("user_id", "event_id", F.round(z, 6).alias("z"), F.round(F.percent_rank().over(w.orderBy("value")), 6).alias("pr"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top1_top_n(spark, d):
    return K.top_or_threshold(table(spark, d, "orders"), "o_totalprice", "o_orderkey", n=100).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 350000")
def top1_threshold(spark, d):
    return K.top_or_threshold(table(spark, d, "orders"), "o_totalprice", "o_orderkey", threshold=350000).select("o_orderkey", "o_totalprice")


@query("select event_id, s from (select event_id, case when event_id % 4 = 0 then null else value end as s from events)")
def top2_sort_nulls_last(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("s")).orderBy(F.asc_nulls_last("s"), "event_id")


@query("select p_brand, p_partkey, rn from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from part) where rn <= 3")
def top3_top_n_per_group(spark, d):
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    return K.top_per_group(table(spark, d, "part"), ["p_brand"], order, 3, place="rn").select("p_brand", "p_partkey", F.col("rn").cast("long").alias("rn"))


@query("select p_partkey, round(sqrt(p_retailprice) * p_size, 6) as fine from (select * from part order by p_retailprice desc, p_partkey limit 200) order by sqrt(p_retailprice) * p_size desc, p_partkey limit 20")
def top4_two_stage(spark, d):
    """A cheap order picks 200 parts, a function of batches scores them, the best 20 stay."""

    def refine(batches):
        for pdf in batches:
            yield pdf.assign(fine=(pdf["p_retailprice"] ** 0.5 * pdf["p_size"]))[["p_partkey", "fine"]]

    coarse = K.top_or_threshold(table(spark, d, "part"), "p_retailprice", "p_partkey", n=200).select("p_partkey", "p_retailprice", "p_size")
    fine = coarse.mapInPandas(refine, "p_partkey long, fine double")
    return K.top_or_threshold(fine, "fine", "p_partkey", n=20).select("p_partkey", F.round("fine", 6).alias("fine"))


@query("select y::int as y, least(count(*) filter (quality = 0), count(*) filter (quality = 1)) as n from labels, (select unnest([0, 1]) as y) group by y")
def top5_balanced_classes(spark, d):
    """The rarer label (0 here) in full and as many of the other."""
    rows = table(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("rare"))
    return K.balanced(rows, "rare", "doc_id", 11).groupBy((1 - F.col("rare")).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n, count(distinct event_id) as n_distinct from (select event_id from events limit 1000)")
def top6_hash_sample(spark, d):
    return K.hash_sample(table(spark, d, "events"), ["event_id"], 1000, 5).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("event_id")).alias("n_distinct"))


@query("select p_type, p_partkey from (select *, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as rn from part) join (values ('ECONOMY', 30), ('PROMO', 10), ('STANDARD', 20)) q(p_type, quota) using (p_type) where rn <= quota")
def top7_quotas(spark, d):
    quota = spark.createDataFrame([("ECONOMY", 30), ("PROMO", 10), ("STANDARD", 20)], "p_type string, quota int")
    rows = table(spark, d, "part").join(F.broadcast(quota), "p_type")
    most = quota.agg(F.max("quota")).first()[0]
    return K.top_per_group(rows, ["p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")], F.col("quota"), most).select("p_type", "p_partkey")
