"""Routing of documents to groups of benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as X
from .filtering import _CLEAN, _REFS, references
from .registry import query, table
from .similarity import _sets

_GROUPS = ["A", "B", "C", "D", "Z"]
_SCORES = (
    f"{_REFS}, s as {_sets('documents', 'doc_id')}, n as (select k, count(*) as n from s group by k), b as {_sets('benchmark', 'item_id')}, m as (select k, count(*) as n from b group by k), "
    "p as (select s.k as l, b.k as r, count(*) as c from s join b using (e) group by all), q as (select l as doc_id, r as ref_id, c / (n.n + m.n - c) as sim, false as contained from p join n on n.k = l join m on m.k = r), "
    f"h as (select doc_id, ref_id, 0.0 as sim, true as contained from documents, refs where contains(' ' || {_CLEAN.format('text')} || ' ', ' ' || pattern || ' ')), "
    "g as (select ref_id, unnest(string_split(site, '|')) as grp from refs), "
    "sc as (select doc_id, grp, max(sim) as sim, bool_or(contained) as contained, max(sim) + bool_or(contained)::int as combined from (select * from q union all select * from h) join g using (ref_id) group by all), "
    "sz as (select grp, count(*) as size from g group by grp)"
)


def _best(order, extra=""):
    return f"bb as (select * from (select *, row_number() over (partition by doc_id order by {order}) as rn from sc join sz using (grp) {extra}) where rn = 1)"


def scores(spark, d):
    return X.route_scores(table(spark, d, "documents"), "doc_id", "text", references(spark, d))


def sizes(spark, d):
    return references(spark, d).select(F.explode(F.split("site", r"\|")).alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("size"))


@query(f"with {_SCORES} select doc_id, grp, round(sim, 6) as sim, contained, round(combined, 6) as combined from sc")
def jon15_route_scores(spark, d):
    return scores(spark, d).withColumns({"sim": F.round("sim", 6), "combined": F.round("combined", 6)})


@query("select user_id, g as grp, round(count(distinct event_type) / max(size), 6) as share, string_agg(distinct event_type, ',' order by event_type) as matched from events join (values ('buy', 'purchase', 3), ('buy', 'click', 3), ('buy', 'view', 3), ('fail', 'error', 1)) s(g, item, size) on item = event_type group by all")
def jon14_signature_match(spark, d):
    signatures = spark.createDataFrame([("buy", "purchase"), ("buy", "click"), ("buy", "view"), ("fail", "error")], "grp string, item string")
    return X.signature_match(table(spark, d, "events"), "user_id", "event_type", signatures).withColumn("share", F.round("share", 6))


@query(f"with {_SCORES}, {_best('combined desc, size desc, grp')} select doc_id, case when contained or (sim >= 0.02 and combined > 0) then grp end as assigned from bb")
def win7_argmax_group(spark, d):
    return X.assign(scores(spark, d), "doc_id", sizes(spark, d), 0.02).select("doc_id", "assigned")


@query(f"with {_SCORES}, {_best('combined desc, grp')} select doc_id, case when contained or combined > 0 then grp end as assigned from bb")
def win8_argmax_by_label(spark, d):
    return X.assign(scores(spark, d), "doc_id").select("doc_id", "assigned")


_AC = "where grp in ('A', 'C')"


@query(f"with {_SCORES}, {_best('combined desc, size desc, grp', _AC)} select doc_id, case when sim >= 0.02 and combined > 0 then grp end as assigned from bb")
def win9_argmax_strict(spark, d):
    return X.assign(scores(spark, d), "doc_id", sizes(spark, d), 0.02, ["A", "C"], strict=True).select("doc_id", "assigned")


@query(f"with {_SCORES} select doc_id, grp, round(combined, 6) as combined from (select *, max(combined) over (partition by doc_id) as best from sc) where contained or combined >= best - 0.1::double")
def win14_multi_assignment(spark, d):
    return X.assign_many(scores(spark, d), "doc_id", 0.1).withColumn("combined", F.round("combined", 6))


@query("select count(*) as n, 1.0::double as share_correct from benchmark")
def agg26_self_routing(spark, d):
    """Do references route to one of their own groups?"""
    refs = references(spark, d)
    own = X.assign(X.route_scores(refs.withColumnRenamed("ref_id", "own"), "own", "pattern", refs), "own", sizes(spark, d))
    checked = own.join(refs.withColumnRenamed("ref_id", "own"), "own").withColumn("ok", F.array_contains(F.split("site", r"\|"), F.col("assigned")))
    return checked.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("share_correct"))


@query(f"with {_SCORES}, {_best('combined desc, size desc, grp')} select coalesce(case when contained or (sim >= 0.02 and combined > 0) then grp end, 'unassigned') as grp, count(*) as n, count(*) filter (contained) as n_contained from bb group by 1")
def agg30_routing_summary(spark, d):
    out = X.assign(scores(spark, d), "doc_id", sizes(spark, d), 0.02)
    return out.groupBy(F.coalesce("assigned", F.lit("unassigned")).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_if("contained").alias("n_contained"))


@query(f"with {_SCORES} select d.doc_id, " + ", ".join(f"round(coalesce(max(sim) filter (grp = '{g}'), 0), 6) as {g}_sim, coalesce(max(contained::int::double) filter (grp = '{g}'), 0) as {g}_contained" for g in _GROUPS) + " from documents d left join sc on sc.doc_id = d.doc_id group by d.doc_id")
def agg31_group_features(spark, d):
    out = X.group_features(table(spark, d, "documents"), "doc_id", scores(spark, d), _GROUPS)
    return out.withColumns({f"{g}_sim": F.round(f"{g}_sim", 6) for g in _GROUPS})


@query(
    f"with {_REFS}, e as (select distinct item_id as ref_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as e from benchmark), n as (select ref_id, count(*) as n from e group by 1), "
    "p as (select a.ref_id as l, b.ref_id as r, count(*) as c from e a join e b using (e) group by all), g as (select r.ref_id, b.text, unnest(string_split(site, '|')) as grp from refs r join benchmark b on b.item_id = r.ref_id), "
    "z as (select x.grp as g1, y.grp as g2, coalesce(p.c / (nx.n + ny.n - p.c), 0) as sim from g x join g y on x.text <> y.text join n nx on nx.ref_id = x.ref_id join n ny on ny.ref_id = y.ref_id left join p on p.l = x.ref_id and p.r = y.ref_id) "
    "select g1, g2, round(avg(sim), 6) as mean, round(max(sim), 6) as max, count(*) as n from z group by all"
)
def agg33_group_similarity(spark, d):
    return X.group_similarity(references(spark, d)).withColumns({"mean": F.round("mean", 6), "max": F.round("max", 6)})


@query("select l_orderkey, l_linenumber, coalesce(case when l_returnflag <> 'N' then l_returnflag end, 'DEFAULT') as grp, round(l_extendedprice / sum(l_extendedprice) over (partition by l_suppkey, coalesce(case when l_returnflag <> 'N' then l_returnflag end, 'DEFAULT')), 6) as score from lineitem")
def mdl18_score_per_group(spark, d):
    """Route, default group for the unassigned, a function per group, one row out for each row in."""

    def share(pdf):
        return pdf.assign(score=pdf["l_extendedprice"] / pdf["l_extendedprice"].sum())[["l_orderkey", "l_linenumber", "grp", "score"]]

    routed = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.coalesce(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.lit("DEFAULT")).alias("grp"))
    scored = routed.groupBy("l_suppkey", "grp").applyInPandas(share, "l_orderkey long, l_linenumber int, grp string, score double")
    return scored.withColumn("score", F.round("score", 6))
