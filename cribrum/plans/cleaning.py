"""Cleaning, lookups, replicate and batch statistics; ``events`` are the measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters, replicates as R
from .registry import query, table


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """id, batch (YYYYMMDD), value, attr, p: the events as raw measurements."""
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("id"), F.date_format("ts", "yyyyMMdd").alias("batch"), "value", F.col("event_type").alias("attr"), S.neg_log10(F.col("value")).alias("p")
    )


_M = "m as (select event_id, user_id as id, strftime(ts, '%Y%m%d') as batch, value, event_type as attr, case when value > 0 then -log10(value) end as p from events)"


@query(
    f"with {_M}, a as (select id, batch, arg_min(attr, event_id) as attr, avg(p) as mean from m group by all), "
    "c as (select id, arg_min(attr, batch) as attr, avg(mean) as gm, stddev_samp(mean) as gs, count(distinct batch) as n_batches from a group by id), "
    "k as (select *, row_number() over (order by gm) as rn, count(*) over () as n from c) "
    "select id, attr, round(gm, 6) as global_mean, round(gs, 6) as global_std, n_batches, gm >= (select gm from k where rn = 1 + round(0.75 * (n - 1))) as label, "
    "round((select gm from k where rn = 1 + round(0.75 * (n - 1))), 6) as threshold from c"
)
def labelled_entities(spark, d):
    """Measurements to one cleaned, labelled row per entity (AGG1, AGG2, FLT10)."""
    averaged = R.average_by_batch(measurements(spark, d), "id", "batch", "p", ["attr"], "event_id")
    entities = R.collapse(averaged, "id", "batch", "mean", ["attr"])
    return filters.quantile_labels(entities, "global_mean", 0.75).withColumns({c: F.round(c, 6) for c in ("global_mean", "global_std", "threshold")})


@query(f"with {_M} select id, batch, arg_min(attr, event_id) as attr, round(avg(p), 6) as mean, round(stddev_samp(p), 6) as std, count(p) as n from m group by id, batch")
def agg1_average_by_batch(spark, d):
    out = R.average_by_batch(measurements(spark, d), "id", "batch", "p", ["attr"], "event_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    f"with {_M}, a as (select id, batch, arg_min(attr, event_id) as attr, avg(p) as mean from m group by all) "
    "select id, arg_min(attr, batch) as attr, round(avg(mean), 6) as global_mean, round(stddev_samp(mean), 6) as global_std, count(distinct batch) as n_batches from a group by id"
)
def agg2_collapse_to_entity(spark, d):
    averaged = R.average_by_batch(measurements(spark, d), "id", "batch", "p", ["attr"], "event_id")
    return R.collapse(averaged, "id", "batch", "mean", ["attr"]).withColumns({c: F.round(c, 6) for c in ("global_mean", "global_std")})


@query("select user_id as id, round(median(value), 6) as median from events group by 1")
def agg3_median_per_key(spark, d):
    return R.median_per_key(measurements(spark, d), "id", "value").withColumn("median", F.round("median", 6))


@query("select o_custkey as k, count(distinct o_orderpriority) as n_values from orders group by 1 having count(distinct o_orderpriority) > 1")
def agg4_ambiguous_keys(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return R.ambiguous(orders, "k", "o_orderpriority")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(distinct o_orderpriority) <= 1)")
def agg4_unambiguous_rows(spark, d):
    return R.unambiguous_rows(table(spark, d, "orders"), "o_custkey", "o_orderpriority").select("o_orderkey", "o_custkey")


@query(
    "select event_type as attr, count(*) as n_rows, count(distinct user_id) as n_ids, count(distinct value) as n_values, count(value) as n_present, "
    "count(*) filter (value > 100) as n_high, round(median(value), 6) as median from events group by 1"
)
def agg5_class_summary(spark, d):
    rows = measurements(spark, d)
    sums = rows.groupBy("attr").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col("id")).alias("n_ids"), F.count_distinct(F.col("value")).alias("n_values"), F.count("value").alias("n_present"),
        F.count_if(F.col("value") > 100).alias("n_high"),
    )
    return R.with_quantiles(sums, ["attr"], rows, "value", {"median": 0.5}).withColumn("median", F.round("median", 6))


@query(
    f"with {_M} select batch, count(*) as n, count(distinct id) as n_ids, round(avg(p), 6) as mean, round(median(p), 6) as median, round(stddev_samp(p), 6) as std, "
    "round(quantile_cont(p, 0.25), 6) as q25, round(quantile_cont(p, 0.75), 6) as q75 from m where p is not null group by batch"
)
def agg6_batch_stats(spark, d):
    return R.batch_stats(measurements(spark, d), "batch", "id", "p").withColumns({c: F.round(c, 6) for c in ("mean", "median", "std", "q25", "q75")})


_SPREAD = "w as (select id, count(*) as n, count(distinct batch) as n_batches, avg(p) as mean, stddev_samp(p) as std, min(p) as min, max(p) as max from m where p is not null group by id)"


@query(f"with {_M}, {_SPREAD} select id, n, n_batches, round(mean, 6) as mean, round(std, 6) as std, round(min, 6) as min, round(max, 6) as max, round(max - min, 6) as range from w")
def agg7_within_key_spread(spark, d):
    return R.within_key_spread(measurements(spark, d), "id", "batch", "p").withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "max", "range")})


@query(
    f"with {_M}, {_SPREAD} select count(*) as n_ids, round(median(std), 6) as median_std, round(avg(std), 6) as mean_std, round(quantile_cont(std, 0.9), 6) as p90_std, round(max(std), 6) as max_std from w where n >= 2"
)
def agg7_reproducibility(spark, d):
    out = R.reproducibility(R.within_key_spread(measurements(spark, d), "id", "batch", "p"))
    return out.select("n_ids", *[_r(c) for c in ("median_std", "mean_std", "p90_std", "max_std")])


@query(
    f"with {_M}, g as (select batch, count(p) as n, avg(p) as mean, var_pop(p) as var, median(p) as med from m where p is not null group by batch), t as (select sum(n * mean) / sum(n) as grand from g) "
    "select round(sum(n * power(mean - grand, 2)) / (sum(n * power(mean - grand, 2)) + sum(n * var)), 6) as r2, round(max(med) - min(med), 6) as median_spread, count(*) as n_groups from g, t"
)
def agg8_variance_explained(spark, d):
    return R.variance_explained(measurements(spark, d), "batch", "p").select(_r("r2"), _r("median_spread"), "n_groups")


@query(f"with {_M} select batch, attr, count(distinct id) as n_ids, round(median(p), 6) as median, round(avg(p), 6) as mean, count(*) as n_rows from m group by batch, attr")
def agg9_composition(spark, d):
    return R.composition(measurements(spark, d), "batch", "attr", "id", "p").withColumns({c: F.round(c, 6) for c in ("median", "mean")})


@query(
    "select strftime(ts, '%Y%m%d') as batch, " + ", ".join(f"coalesce(count(*) filter (event_type = '{t}'), 0) as {t}" for t in ("click", "purchase", "view")) + " from events group by 1"
)
def agg9_composition_matrix(spark, d):
    return measurements(spark, d).groupBy("batch").pivot("attr", ["click", "purchase", "view"]).count().na.fill(0)


@query(
    "select count(value) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, round(quantile_cont(value, 0.25), 6) as q25, round(median(value), 6) as median, "
    "round(quantile_cont(value, 0.75), 6) as q75, round(quantile_cont(value, 0.9), 6) as q90, max(value) as max from events"
)
def agg10_distribution(spark, d):
    return R.distribution(measurements(spark, d), "value").withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "median", "q75", "q90")})


@query(
    "select d.lang, count(*) as n, sum(quality)::bigint as positives, round(avg(quality), 6) as prevalence, d.lang = 'fr' as is_holdout, sum(quality) in (0, count(*)) as one_class from documents d join labels using (doc_id) group by d.lang"
)
def agg11_label_breakdown(spark, d):
    labelled = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    folded = labelled.withColumn("is_holdout", F.col("lang") == "fr")
    return folded.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("positives"), F.round(F.avg("quality"), 6).alias("prevalence"), F.bool_or("is_holdout").alias("is_holdout"),
        F.sum("quality").isin(0).__or__(F.sum("quality") == F.count(F.lit(1))).alias("one_class"),
    )


@query(f"with {_M} select count(*) as n_rows, count(distinct id) as n_ids, count(*) filter (id is not null and p is not null) as n_complete, count(distinct batch) as n_batches, min(batch) as first, max(batch) as last from m")
def agg12_global_counters(spark, d):
    return measurements(spark, d).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col("id")).alias("n_ids"), F.count_if(F.col("id").isNotNull() & F.col("p").isNotNull()).alias("n_complete"),
        F.count_distinct(F.col("batch")).alias("n_batches"), F.min("batch").alias("first"), F.max("batch").alias("last"),
    )


@query("select user_id, count(*) as n, round(100.0 * count(*) / (select count(*) from events), 4) as pct from events group by 1 order by n desc, user_id limit 20")
def agg13_value_frequency(spark, d):
    events = table(spark, d, "events")
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(20).withColumn("pct", F.round(100.0 * F.col("n") / F.lit(events.count()), 4))


@query("select l_linenumber as value, count(*) as n from lineitem group by 1")
def agg14_integer_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("select least(cast(floor(l_discount / 0.01) as int), 9) as bin, count(*) as n, round(min(l_discount), 4) as low from lineitem group by 1")
def agg14_fixed_bin_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy(S.equal_width_bin(F.col("l_discount"), 10, 0.0, 0.1).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("l_discount"), 4).alias("low"))


_RAW = "r as (select event_id, case event_id % 5 when 0 then ' Reference ' || user_id when 1 then 'X-' || user_id || '*' when 2 then 'CMPD' || user_id when 3 then user_id || ' dmso blank' else cast(user_id as varchar) end as raw from events)"


def _raw_ids(spark, d):
    u = F.col("user_id").cast("string")
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" Reference "), u)).when(F.col("event_id") % 5 == 1, F.concat(F.lit("X-"), u, F.lit("*")))
    raw = raw.when(F.col("event_id") % 5 == 2, F.concat(F.lit("CMPD"), u)).when(F.col("event_id") % 5 == 3, F.concat(u, F.lit(" dmso blank"))).otherwise(u)
    return table(spark, d, "events").select("event_id", raw.alias("raw"))


@query(f"with {_RAW} select event_id, case when trim(raw) like 'CMPD1%' then 'CMPD-ONE' when trim(raw) like '%dmso%' then 'DMSO' else regexp_replace(regexp_replace(trim(raw), '^Reference\\s*', ''), '\\*$', '') end as id from r")
def scl1_clean_id(spark, d):
    return _raw_ids(spark, d).select("event_id", S.clean_id(F.col("raw"), {"CMPD1": "CMPD-ONE"}, {"dmso": "DMSO"}).alias("id"))


@query(
    f"with {_RAW} select event_id, case when trim(raw) = '' then 'empty' when raw like 'CMPD%' then 'compound' when raw like 'X-%' then 'external' when raw like ' Ref%' then 'reference' when regexp_matches(raw, '^[0-9]') then 'numeric' else 'other' end as class from r"
)
def scl2_prefix_class(spark, d):
    return _raw_ids(spark, d).select("event_id", S.prefix_class(F.col("raw"), {"CMPD": "compound", "X-": "external", " Ref": "reference"}).alias("class"))


@query("select event_id, coalesce(try_cast(event_type as double), try_cast(case when event_id % 3 = 0 then 'n/a' else cast(value as varchar) end as double), cast(user_id as double)) as x from events")
def scl3_first_number(spark, d):
    shown = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", S.first_number(F.col("event_type"), shown, F.col("user_id")).alias("x"))


@query("select event_id, round(case when value - 5 > 0 then -log10(value - 5) end, 8) as p from events")
def scl4_neg_log10(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.neg_log10(F.col("value") - 5), 8).alias("p"))


@query("select l_returnflag, round(avg((l_quantity <= 30 and l_discount <= 0.08 and l_tax <= 0.06 and l_extendedprice <= 60000)::int), 6) as pass_rate, count(*) as n from lineitem group by 1")
def scl5_compliance(spark, d):
    ok = S.compliant([(F.col("l_quantity"), 30), (F.col("l_discount"), 0.08), (F.col("l_tax"), 0.06), (F.col("l_extendedprice"), 60000)])
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(ok.cast("int")), 6).alias("pass_rate"), F.count(F.lit(1)).alias("n"))


@query(
    "select o_orderkey, coalesce(v.name, c.c_name, s.s_name) as name, case when v.name is not null then 'override' when c.c_name is not null then 'primary' when s.s_name is not null then 'secondary' else 'unresolved' end as name_source "
    "from (select o_orderkey, o_custkey * 2 as k from orders) o left join (select c_custkey as k, 'VIP' || c_custkey as name from customer where c_custkey % 7 = 0) v using (k) left join customer c on c.c_custkey = o.k left join supplier s on s.s_suppkey = o.k"
)
def jon1_lookup_cascade(spark, d):
    customer = table(spark, d, "customer")
    override = customer.where("c_custkey % 7 = 0").select("c_custkey", F.concat(F.lit("VIP"), F.col("c_custkey").cast("string")))
    sources = [("override", override), ("primary", customer.select("c_custkey", "c_name")), ("secondary", table(spark, d, "supplier").select("s_suppkey", "s_name"))]
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("k"))
    return R.lookup_cascade(orders, "k", sources, "name").select("o_orderkey", "name", "name_source")


@query("select doc_id, lang, quality, toxic from documents join labels using (doc_id)")
def jon2_inner_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("select o_orderkey, o_custkey, c_mktsegment from orders left join customer on c_custkey = o_custkey")
def jon3_enrich_strict(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return R.enrich_strict(table(spark, d, "orders").select("o_orderkey", "o_custkey"), customer, "o_custkey", ["c_mktsegment"])


@query("select doc_id, quality, n_chars / 1000.0 as m0, n_chars / 2000.0 as m1, n_chars / 4000.0 as m2 from documents join labels using (doc_id)")
def jon4_join_predictions(spark, d):
    base = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    tables = [(f"m{i}", base.select("doc_id", "quality", (F.col("n_chars") / (1000.0 * 2**i)).alias("p"))) for i in range(3)]
    return R.join_all(tables, ["doc_id", "quality"], "p")


@query("select c_custkey, c_custkey in (select o_custkey from orders) as has_orders from customer")
def jon5_membership(spark, d):
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_in", F.lit(True))
    return table(spark, d, "customer").join(buyers, "c_custkey", "left").select("c_custkey", F.col("_in").isNotNull().alias("has_orders"))


@query("select o_orderkey as k, 'high' as part from orders where o_totalprice >= 300000 union all select o_orderkey, 'low' from orders where o_totalprice < 50000")
def set1_concat(spark, d):
    orders = table(spark, d, "orders")
    parts = [orders.where("o_totalprice >= 300000").select(F.col("o_orderkey").alias("k"), F.lit("high").alias("part")), orders.where("o_totalprice < 50000").select(F.col("o_orderkey").alias("k"), F.lit("low").alias("part"))]
    return reduce(DataFrame.unionAll, parts)


@query("select c_custkey as k, c_name as name, c_mktsegment as segment from customer union all by name select s_suppkey as k, s_name as name, s_acctbal as balance from supplier")
def set2_union_by_name(spark, d):
    customer = table(spark, d, "customer").selectExpr("c_custkey as k", "c_name as name", "c_mktsegment as segment")
    return customer.unionByName(table(spark, d, "supplier").selectExpr("s_suppkey as k", "s_name as name", "s_acctbal as balance"), allowMissingColumns=True)


@query("select l_orderkey, l_linenumber, 'discount' as model, l_discount as value from lineitem union all select l_orderkey, l_linenumber, 'tax', l_tax from lineitem")
def set3_stack(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount as discount", "l_tax as tax")
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "model", "value")


@query("select distinct l_suppkey, l_returnflag from lineitem")
def set4_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def set5_key_difference(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")
