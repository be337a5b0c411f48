"""Filters, funnels, labels and wide summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as X
from ..operators.replicates import with_quantiles
from ..operators.similarity import nearest_reference
from .registry import query, table
from .similarity import _NEAR as NEAR, sets

_WORDS = ["tion the", "ing", "erth", "the", "heou", "tion the"]


@query("select doc_id from documents where coalesce(contains(text, 'tion the') or contains(text, 'erth') or contains(text, 'heou'), false)")
def flt1_literal_prefilter(spark, d):
    return table(spark, d, "documents").where(X.any_literal(F.col("text"), _WORDS)).select("doc_id")


@query(
    "with p as (select distinct unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D,.;:!?]+')) as p from documents) "
    "select conv_id, turn, coalesce((select count(*) from p where length(p) >= 10 and contains(text, p)), 0) as n_hits from conversations"
)
def flt1_many_literals(spark, d):
    """Every word of ten letters or more of the documents as a pattern: 16,000 at sf0.01, in several blocks."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[^\\x20\\x09-\\x0D,.;:!?]+"), F.lit(0))).alias("p")
    patterns = table(spark, d, "documents").select(words)
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return X.literal_hits(turns, "text", patterns, "n_hits", least=10, block=64 << 10).select("conv_id", "turn", "n_hits")


_RANGES, _SUMS = {"l_quantity": (5, 40), "l_discount": (None, 0.08), "l_extendedprice": (1000, None)}, [(["l_tax", "l_discount"], 0.1)]
_OK = ["l_quantity >= 5 and l_quantity <= 40", "l_discount <= 0.08", "l_extendedprice >= 1000", "l_tax + l_discount <= 0.1"]


def _steps():
    return [
        ("quantity", X.within({"l_quantity": (5, 40)})), ("discount", X.within({"l_discount": (None, 0.08)})), ("price", X.within({"l_extendedprice": (1000, None)})),
        ("charges", X.within({}, [(["l_tax", "l_discount"], 0.1)])),
    ]


@query(f"select l_orderkey, l_linenumber, l_partkey from lineitem where {' and '.join(_OK)}")
def flt2_property_filter(spark, d):
    return X.property_filter(table(spark, d, "lineitem"), _RANGES, _SUMS).select("l_orderkey", "l_linenumber", "l_partkey")


def _funnel_sql() -> str:
    names, parts = ["quantity", "discount", "price", "charges"], []
    for i, name in enumerate(names):
        before = " and ".join(_OK[:i]) or "true"
        parts.append(f"select {i + 1} as step, '{name}' as name, count(*) filter ({before} and not ({_OK[i]})) as failed, count(*) filter ({before} and {_OK[i]}) as remaining from lineitem")
    return " union all ".join(parts)


@query(_funnel_sql())
def flt3_funnel(spark, d):
    return X.funnel(table(spark, d, "lineitem"), _steps())


@query("select case " + " ".join(f"when not ({ok}) then 'fail_{n}'" for n, ok in zip(["quantity", "discount", "price", "charges"], _OK)) + " else 'out' end as reason, count(*) as n from lineitem group by 1")
def flt4_first_failure(spark, d):
    steps = [(f"fail_{n}", ok) for n, ok in _steps()]
    return table(spark, d, "lineitem").groupBy(X.first_failure(steps).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_BAD = {"shout": "[A-Z]{3,}!!", "symbols": "[*$%&#]{3}", "table": " \\| ", "license": "Licensed under"}
_BAD_SQL = ", ".join(f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in _BAD.items())


@query(f"select doc_id, array_to_string(list_filter([{_BAD_SQL}], lambda x: x is not null), ',') as matched from documents where text is not null")
def flt5_bad_patterns(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(X.matched_names(F.col("text"), _BAD), ",").alias("matched"))


@query(f"select name, count(*) as n from (select unnest([{_BAD_SQL}]) as name from documents) where name is not null group by 1")
def flt6_pattern_breakdown(spark, d):
    return table(spark, d, "documents").select(F.explode(X.matched_names(F.col("text"), _BAD)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_CLEAN = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_REFS = f"refs as (select item_id as ref_id, chr(65 + (item_id % 4)::int) || case when item_id % 5 = 0 then '|Z' else '' end as site, {_CLEAN.format('text')} as pattern from benchmark)"


def references(spark, d):
    """The benchmark items as reference patterns of one or two groups."""
    site = F.concat(F.char((F.lit(65) + F.col("item_id") % 4).cast("int")), F.when(F.col("item_id") % 5 == 0, "|Z").otherwise(""))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("ref_id"), site.alias("site"), F.col("text").alias("pattern"))


@query(
    f"with {_REFS}, h as (select doc_id, ref_id, site from documents, refs where contains(' ' || {_CLEAN.format('text')} || ' ', ' ' || pattern || ' ')), "
    "s as (select doc_id, unnest(string_split(site, '|')) as one from h) "
    "select doc_id, count(*) as n_hits, string_agg(ref_id::varchar, ',' order by ref_id::varchar) as refs, (select string_agg(distinct one, '|' order by one) from s where s.doc_id = h.doc_id) as matched_sites from h group by doc_id"
)
def flt7_containment_gate(spark, d):
    return X.containment_gate(table(spark, d, "documents"), "doc_id", "text", references(spark, d))


@query(
    f"with {_REFS}, t as materialized (select doc_id, ' ' || {_CLEAN.format('text')} || ' ' as t from documents), h as materialized (select doc_id, ref_id from t, refs where contains(t, ' ' || pattern || ' ')) "
    "select d.doc_id, ref_id, h.ref_id is not null as hit from (select distinct doc_id from h) d cross join refs left join h using (doc_id, ref_id)"
)
def flt7_reference_flags(spark, d):
    return X.reference_flags(table(spark, d, "documents"), "doc_id", "text", references(spark, d))


@query("select event_id, value, value > 60 as label, 20.0::double as filter_lo, 60.0::double as filter_hi from events where not (value between 20 and 60)")
def flt8_gray_zone(spark, d):
    return X.gray_zone(table(spark, d, "events").select("event_id", "value"), "value", 20.0, 60.0)


@query("select event_id, case when value >= 60 then 1 else 0 end as label, 'events' as label_source from events where value >= 60 or value <= 20 union all select o_orderkey, case when o_totalprice >= 300000 then 1 else 0 end, 'orders' from orders where o_totalprice >= 300000 or o_totalprice <= 50000")
def flt9_two_thresholds(spark, d):
    a = X.two_thresholds(table(spark, d, "events"), "value", 20, 60, "events").select("event_id", "label", "label_source")
    b = X.two_thresholds(table(spark, d, "orders"), "o_totalprice", 50000, 300000, "orders").select(F.col("o_orderkey").alias("event_id"), "label", "label_source")
    return a.unionByName(b)


@query("with t as (select o_totalprice as threshold from (select o_totalprice, row_number() over (order by o_totalprice) as rn, count(*) over () as n from orders) where rn = 1 + round(0.8 * (n - 1))) select o_orderkey, o_totalprice >= threshold as label, threshold from orders, t")
def flt10_quantile_labels(spark, d):
    return X.quantile_labels(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.8).select("o_orderkey", "label", "threshold")


@query("select vec_id, label as fold, 3 as holdout_fold, label = 3 as is_holdout from embeddings")
def flt11_holdout_override(spark, d):
    return X.holdout_override(table(spark, d, "embeddings").select("vec_id", F.col("label").alias("fold")), "fold", 3)


@query("select case when text is null then 'null_text' when trim(text) = '' then 'blank' when n_chars < 40 then 'short' else 'kept' end as reason, count(*) as n from documents group by 1")
def flt12_drop_invalid(spark, d):
    rules = [("null_text", F.col("text").isNotNull()), ("blank", F.trim("text") != ""), ("short", F.col("n_chars") >= 40)]
    return X.drop_invalid(table(spark, d, "documents"), rules)[1]


@query("select doc_id from documents where not regexp_matches(coalesce(text, ''), '(?:(?i:licensed under))|(?:^[A-Z]{4,})|(?:\\|)')")
def flt13_annotation_rows(spark, d):
    return table(spark, d, "documents").where(X.not_annotation(F.col("text"), ["(?i:licensed under)", "^[A-Z]{4,}", "\\|"])).select("doc_id")


@query("select l_orderkey, l_linenumber, l_returnflag from lineitem where l_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') and l_orderkey in (select l_orderkey from lineitem where l_returnflag = 'A')")
def flt14_required_key(spark, d):
    return X.require_key(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", "l_returnflag", "R", "A")


@query(NEAR + ", g as (select doc_id, lang, log10(n_chars + 1.0::double) as score, coalesce(max_sim, 0) as sim from documents left join t on l = doc_id) select doc_id, lang from g where score >= (select max(score) from g b where b.lang is not distinct from g.lang) - 1 and sim >= 0.001 and sim <= 0.35")
def flt15_final_gate(spark, d):
    """Score within 1 of the best of its language, somewhat similar to a reference, and novel."""
    near = nearest_reference(sets(spark, d), "doc_id", "items", sets(spark, d, "benchmark", "item_id").withColumnRenamed("items", "ref"), "item_id", "ref").select("doc_id", "max_sim")
    rows = table(spark, d, "documents").select("doc_id", "lang", F.log10(F.col("n_chars") + 1.0).alias("score")).join(near, "doc_id")
    return X.final_gate(rows, "lang", "score", 1.0, [F.col("max_sim") >= 0.001, F.col("max_sim") <= 0.35]).select("doc_id", "lang")


@query("select o_custkey, count(*) as n, case when count(*) >= 5 then round(avg(o_totalprice), 6) end as mean from orders group by 1")
def flt16_suppress_small(spark, d):
    stats = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"))
    return X.suppress_small(stats, ["mean"], "n")


def flags(spark, d):
    """Documents with one flag column a pattern."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", *[F.coalesce(F.col("text").rlike(p), F.lit(False)).alias(f"flag_{n}") for n, p in _BAD.items()])


@query(" union all ".join(f"select 'flag_{n}' as flag, count(*) filter (regexp_matches(text, '{p}')) as n from documents" for n, p in _BAD.items()))
def agg15_flag_sums(spark, d):
    rows = flags(spark, d)
    names = [c for c in rows.columns if c.startswith("flag_")]
    return rows.agg(*[F.count_if(c).alias(c) for c in names]).unpivot([], names, "flag", "n").orderBy(F.desc("n"), "flag")


@query(" union all ".join(f"select '{c}' as name, round(min({c}), 4) as low, round(avg({c}), 4) as mean, round(max({c}), 4) as high from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def agg16_range_table(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    one = table(spark, d, "lineitem").agg(*[F.struct(*[F.round(f(c), 4).alias(n) for n, f in (("low", F.min), ("mean", F.avg), ("high", F.max))]).alias(c) for c in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}.low").alias("low"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.high").alias("high")) for c in names])))


@query("select p_brand, count(*) as n, count(distinct p_type) as n_types, string_agg(distinct p_type, '|' order by p_type) as types from part group by 1")
def agg23_label_list(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("p_type")).alias("n_types"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types")
    )


@query("select l_orderkey, count(*) filter (l_returnflag = 'R') as n_r, count(*) filter (l_returnflag = 'A') as n_a, count(*) filter (l_returnflag = 'N') as n_n, string_agg(distinct l_linestatus, ',' order by l_linestatus) as statuses from lineitem group by 1")
def agg24_type_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        *[F.count_if(F.col("l_returnflag") == t).alias(f"n_{t.lower()}") for t in "RAN"], F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("statuses")
    )


@query("select user_id, event_type, round(min(value), 6) as best, round(stddev_pop(value), 6) as score_std, case when count(*) >= 3 then 'ok' else 'few' end as status from events group by all")
def agg25_best_of_replicates(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.round(F.min("value"), 6).alias("best"), F.round(F.stddev_pop("value"), 6).alias("score_std"), F.when(F.count(F.lit(1)) >= 3, "ok").otherwise("few").alias("status")
    )


@query("select count(*) as final_rows, (select sum(n)::bigint from (select l_suppkey % 4 as part, count(*) as n from lineitem group by 1)) as part_rows, true as equal from lineitem")
def agg28_reconcile_counts(spark, d):
    lines = table(spark, d, "lineitem")
    parts = lines.groupBy((F.col("l_suppkey") % 4).alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("part_rows"))
    return lines.agg(F.count(F.lit(1)).alias("final_rows")).crossJoin(parts).withColumn("equal", F.col("final_rows") == F.col("part_rows"))


@query("select o_orderpriority, stage, count(*) as n, min(p) as low, max(p) as high, round(median(p), 4) as median from (select o_orderpriority, o_totalprice as p, 'before' as stage from orders union all select o_orderpriority, o_totalprice, 'after' from orders where o_totalprice > 100000) group by all")
def agg29_before_and_after(spark, d):
    orders = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("p"))
    both = orders.withColumn("stage", F.lit("before")).union(orders.where("p > 100000").withColumn("stage", F.lit("after")))
    keys = ["o_orderpriority", "stage"]
    sums = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))
    return with_quantiles(sums, keys, both, "p", {"median": 0.5}).withColumn("median", F.round("median", 4))


@query("select l_orderkey, l_linenumber, round(case when l_quantity > 0 then -l_extendedprice / l_quantity else 0 end, 8) as eff from lineitem")
def scl12_ratio_metric(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.efficiency(F.col("l_extendedprice"), F.col("l_quantity"), 8).alias("eff"))


@query("select event_id, case when event_id % 3 = 0 then 0.0 else value end as x from events")
def scl13_finite(spark, d):
    broken = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", S.finite(broken).alias("x"))


@query("select event_id, least(greatest(floor(value / 25), 0), 19)::int as bin from events")
def scl16_equal_width_bin(spark, d):
    return table(spark, d, "events").select("event_id", S.equal_width_bin(F.col("value"), 20, 0.0, 500.0).alias("bin"))
