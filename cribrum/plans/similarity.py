"""Fingerprints and similarity: word shingles of documents, benchmark items as references, embeddings as dense features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import similarity as X
from ..operators.lineage import few, spread
from ..operators.ranking import positions
from ..operators.replicates import with_quantiles
from .registry import query, table


def sets(spark, d, name="documents", key="doc_id"):
    return spread(table(spark, d, name).select(key, "text")).select(key, S.shingles(F.col("text"), "word", 3).alias("items"))


def hashed(spark, d, columns=None):
    """Per document: its word 3-grams as hashes, and what ``columns`` make of its row; nothing has to be joined to the sets, which are large."""
    columns = columns or {}
    rows = spread(table(spark, d, "documents").select("doc_id", "text", *[c.alias(n) for n, c in columns.items()]))
    return rows.select("doc_id", S.shingle_hashes(F.col("text"), 3).alias("items"), *columns)


def _words(name, key):
    return f"(select {key} as k, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as w from {name})"


def _sets(name, key):
    return f"(select k, unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(w[i:i+2], ' ')))) as e from {_words(name, key)} where len(w) > 0)"


_S, _B = f"s as {_sets('documents', 'doc_id')}, n as (select k, count(*) as n from s group by k)", f"b as {_sets('benchmark', 'item_id')}, m as (select k, count(*) as n from b group by k)"
_NEAR = (
    f"with {_S}, {_B}, p as (select s.k as l, b.k as r, count(*) as c from s join b using (e) group by all), q as (select l, r, c / (n.n + m.n - c) as sim from p join n on n.k = l join m on m.k = r), "
    "t as (select l, max(sim) as max_sim, arg_min(r, -sim * 1000000 + r / 1000000.0) as nearest from q group by l) "
)


@query(f"with s as {_sets('documents', 'doc_id')} select d.doc_id, coalesce(n, 0) as n_shingles from documents d left join (select k, count(*) as n from s group by k) on k = doc_id")
def scl6_word_shingles(spark, d):
    return sets(spark, d).select("doc_id", F.size("items").cast("long").alias("n_shingles"))


@query("select doc_id, len(list_distinct(list_transform(range(1, greatest(1, length(text) - 3) + 1), lambda i: substr(lower(text), i, 4)))) as n_shingles from documents where length(text) > 0")
def scl6_char_shingles(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).where(F.length("text") > 0)
    return docs.select("doc_id", S.count_char_shingles(F.col("text"), 4).alias("n_shingles"))


_VOCABULARY = ["tion", "ing", "sch", "eau", "ción", "the "]


@query("select doc_id, array_to_string(list_filter([" + ", ".join(f"case when contains(lower(text), '{v}') then {i} end" for i, v in enumerate(_VOCABULARY)) + "], lambda x: x is not null), ',') as bits from documents where text is not null")
def scl6_vocabulary_bits(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(S.fingerprint(F.col("text"), vocabulary=_VOCABULARY).cast("array<string>"), ",").alias("bits"))


@query("select item_id, true as same from benchmark")
def scl7_pack_round_trip(spark, d):
    bits = S.fingerprint(F.col("text"), "word", 2, 256)
    rows = table(spark, d, "benchmark").select("item_id", bits.alias("bits"))
    return rows.withColumn("words", S.pack_bits(F.col("bits"), 256)).select("item_id", (S.unpack_bits(F.col("words")) == F.col("bits")).alias("same"))


@query("select l_orderkey, string_agg(distinct (l_partkey % 128 % 32)::varchar, ',' order by (l_partkey % 128 % 32)::varchar) as bits from lineitem group by 1")
def scl8_fold_bits(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 128).cast("int")).alias("b"))
    return rows.select("l_orderkey", F.array_join(F.array_sort(S.fold_bits(F.col("b"), 32).cast("array<string>")), ",").alias("bits"))


@query(f"with {_B} select x.k as i, y.k as j, round((select count(*) from b u join b v on u.e = v.e where u.k = x.k and v.k = y.k) / (x.n + y.n - (select count(*) from b u join b v on u.e = v.e where u.k = x.k and v.k = y.k)), 6) as sim from m x join m y on x.k < y.k")
def scl9_tanimoto(spark, d):
    items = sets(spark, d, "benchmark", "item_id")
    if not few(items, X.SMALL_SET):
        raise ValueError(f"all pairs of more than {X.SMALL_SET} rows")
    other = F.broadcast(items.select(F.col("item_id").alias("j"), F.col("items").alias("b")))
    return items.join(other, F.col("item_id") < F.col("j")).select(F.col("item_id").alias("i"), "j", F.round(S.tanimoto(F.col("items"), F.col("b")), 6).alias("sim"))


@query("select o_orderkey, round(abs(o_totalprice - 100000) / greatest(1 - o_custkey % 11 / 10.0, 0.001), 6) as sali from orders")
def scl10_landscape_index(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(S.landscape_index(F.col("o_totalprice") - 100000, F.col("o_custkey") % 11 / 10.0), 6).alias("sali"))


@query("select vec_id, embedding[1:3]::double[] as head, len(embedding) + 2 as width from embeddings")
def scl14_feature_blocks(spark, d):
    from ..operators.models import feature_blocks

    rows = table(spark, d, "embeddings").withColumns({"a": F.slice("embedding", 1, 3).cast("array<double>"), "b": F.slice("embedding", 4, 61).cast("array<double>"), "c": F.col("label").cast("double"), "e": F.col("vec_id") / 10.0})
    out, _ = feature_blocks(rows, [("dense", ["a", "b"]), ("plain", ["c", "e"])])
    return out.select("vec_id", F.slice("features", 1, 3).alias("head"), F.size("features").cast("long").alias("width"))


@query("select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double - e0[i]::double)), 6) as total from embeddings, (select embedding as e0 from embeddings where vec_id = 0)")
def scl15_difference_features(spark, d):
    rows = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    first = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("e0")))
    return rows.crossJoin(first).select("vec_id", F.round(F.aggregate(S.differences(F.col("embedding"), F.col("e0")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(_NEAR + "select doc_id, round(coalesce(max_sim, 0), 6) as max_sim, nearest from documents left join t on l = doc_id")
def jon6_nearest_reference(spark, d):
    out = X.nearest_reference(sets(spark, d), "doc_id", "items", sets(spark, d, "benchmark", "item_id").withColumnRenamed("items", "ref"), "item_id", "ref")
    return out.select("doc_id", F.round("max_sim", 6).alias("max_sim"), "nearest")


@query(_NEAR + "select doc_id, round(coalesce(max_sim, 0), 6) as max_sim from documents left join t on l = doc_id where coalesce(max_sim, 0) <= 0.01")
def jon7_novelty(spark, d):
    out = X.novel(sets(spark, d), "doc_id", "items", sets(spark, d, "benchmark", "item_id").withColumnRenamed("items", "ref"), "item_id", "ref", 0.01)
    return out.select("doc_id", F.round("max_sim", 6).alias("max_sim"))


_PAIRS = "p as (select x.k as i, y.k as j, count(*) as c from s x join s y on x.e = y.e and x.k < y.k group by all), q as (select i, j, c, a.n + b.n - c as u from p join n a on a.k = i join n b on b.k = j)"


def similar_pairs(spark, d, tenths=7):
    return X.similarity_self_join(hashed(spark, d), "doc_id", "items", tenths)


_LINKS = f"with {_S}, {_PAIRS}, e as (select i, j, c, u from q union all select j, i, c, u from q) "


@query(_LINKS + "select doc_id, least(doc_id, coalesce(min(j) filter (c = u), doc_id)) as class_id, count(j) filter (c * 10 >= u * 7) as n_links from documents left join e on i = doc_id group by doc_id")
def jon8_similarity_join(spark, d):
    return X.similarity_links(hashed(spark, d), "doc_id", "items", 7)


@query(f"with {_S}, {_PAIRS} select i, j, round(c / u, 6) as sim from q where c * 10 >= u * 7")
def jon8_similar_pairs(spark, d):
    return similar_pairs(spark, d).withColumn("sim", F.round("sim", 6))


@query(_LINKS + "select i as doc_id, count(*) as degree from e where c * 10 >= u * 6 group by 1")
def jon16_neighbour_counts(spark, d):
    return X.similarity_links(hashed(spark, d), "doc_id", "items", 6).where("n_links > 0").select("doc_id", F.col("n_links").alias("degree"))


@query()
def jon9_all_pairs_packed(spark, d):
    items = table(spark, d, "benchmark").select("item_id", S.pack_bits(S.fingerprint(F.col("text"), "word", 1, 1024), 1024).alias("words"))
    return X.all_pairs(items, "item_id", "words").withColumn("sim", F.round("sim", 6))


_KNN = (
    "r as (select a.vec_id as query, b.vec_id as neighbour, b.label, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as sim, "
    "row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as place from embeddings a join embeddings b on a.vec_id <> b.vec_id and a.vec_id % 20 = 0)"
)


@query(f"with {_KNN} select query, round(avg(sim), 6) as mean_sim, round(stddev_pop(label), 6) as target_std, round(avg(label), 6) as target_mean from r where place <= 10 group by query")
def jon10_nearest_neighbours(spark, d):
    rows = table(spark, d, "embeddings")
    near = X.nearest_rows(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    labelled = near.join(rows.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour")
    return labelled.groupBy("query").agg(F.round(F.avg("sim"), 6).alias("mean_sim"), F.round(F.stddev_pop("label"), 6).alias("target_std"), F.round(F.avg("label"), 6).alias("target_mean"))


def _of_document():
    """Of a document: its logarithmic length and its source language, which every third lacks."""
    return {"y": F.log10(F.col("n_chars") + 1.0), "g": F.when(F.col("doc_id") % 3 != 0, F.col("lang"))}


def _diffs(spark, d):
    """Similar pairs of documents with the difference of their logarithmic lengths, and their sources; n pairs a row."""
    return X.weighted_pairs(hashed(spark, d, _of_document()), "doc_id", "items", 3, ["y", "g"]).withColumn("diff", F.abs(F.col("y_i") - F.col("y_j")))


_DIFFS = f"{_S}, {_PAIRS}, f as (select doc_id, log10(n_chars + 1.0::double) as y, case when doc_id % 3 <> 0 then lang end as g from documents), z as (select i, j, c / u as sim, abs(a.y - b.y) as diff, a.g as gi, b.g as gj from q join f a on a.doc_id = i join f b on b.doc_id = j where c * 10 >= u * 3)"


@query(f"with {_DIFFS} select least(floor(sim * 20), 19)::int as bin, count(*) as n, case when count(*) >= 10 then round(median(diff), 6) end as median, case when count(*) >= 10 then round(quantile_cont(diff, 0.25), 6) end as q25, case when count(*) >= 10 then round(quantile_cont(diff, 0.75), 6) end as q75 from z group by 1")
def agg17_pair_bins(spark, d):
    return X.pair_bins(_diffs(spark, d), "sim", "diff", "n").withColumns({c: F.round(c, 6) for c in ("median", "q25", "q75")})


@query(f"with {_DIFFS} select count(*) filter (sim >= 0.7) as n_similar, count(*) filter (sim >= 0.7 and diff >= 0.05) as n_cliffs, round(count(*) filter (sim >= 0.7 and diff >= 0.05) / count(*) filter (sim >= 0.7), 6) as rate from z")
def agg18_cliff_rate(spark, d):
    return X.cliff_rate(_diffs(spark, d), "sim", "diff", 0.7, 0.05, "n").withColumn("rate", F.round("rate", 6))


@query(
    f"with {_DIFFS} select case when gi is null or gj is null then 'unassigned' when gi = gj then 'same' else 'cross' end as category, threshold::double as threshold, count(*) as n, round(median(diff), 6) as median, round(avg(diff), 6) as mean, round(stddev_pop(diff), 6) as std, "
    "count(*) filter (diff >= 0.05) as n_cliffs, round(count(*) filter (diff >= 0.05) / count(*), 6) as rate, round(median(sim), 6) as median_sim from z, (select unnest([0.5, 0.7]) as threshold) where sim >= threshold group by all"
)
def agg19_stratified_cliffs(spark, d):
    out = X.stratified_cliffs(_diffs(spark, d), "g_i", "g_j", "sim", "diff", [0.5, 0.7], 0.05, "n")
    return out.withColumns({c: F.round(c, 6) for c in ("median", "mean", "std", "rate", "median_sim")})


@query("select case when doc_id % 3 <> 0 then lang else 'unassigned' end as g, count(*) as n, round(avg(log10(n_chars + 1.0::double)), 6) as mean, round(median(log10(n_chars + 1.0::double)), 6) as median from documents group by 1")
def agg20_group_targets(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 != 0, F.col("lang")).otherwise("unassigned").alias("g"), F.log10(F.col("n_chars") + 1.0).alias("y"))
    sums = docs.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean"))
    return with_quantiles(sums, ["g"], docs, "y", {"median": 0.5}).withColumn("median", F.round("median", 6))


@query(f"with {_DIFFS}, v as (select i, j, diff / greatest(1 - sim, 0.001) as sali from z where sim >= 0.7) select i, j, round(sali, 6) as sali, round(cume_dist() over (order by sali), 6) as cdf from v")
def agg21_index_distribution(spark, d):
    """Row by row, copies expanded; ``agg21_index_values`` gives the distribution without."""
    features = table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in _of_document().items()])
    pairs = similar_pairs(spark, d, 7).join(features.toDF("i", "yi", "gi"), "i").join(features.toDF("j", "yj", "gj"), "j")
    v = pairs.select("i", "j", S.landscape_index(F.abs(F.col("yi") - F.col("yj")), F.col("sim")).alias("sali"))
    return positions(v, "sali").select("i", "j", F.round("sali", 6).alias("sali"), F.round((F.col("below") + F.col("ties")) / F.col("total"), 6).alias("cdf"))


@query(f"with {_DIFFS}, v as (select round(diff / greatest(1 - sim, 0.001), 6) as sali from z where sim >= 0.7) select sali, count(*) as n, round(sum(count(*)) over (order by sali) / sum(count(*)) over (), 6) as cdf from v group by sali")
def agg21_index_values(spark, d):
    v = _diffs(spark, d).where("sim >= 0.7").withColumn("sali", F.round(S.landscape_index(F.col("diff"), F.col("sim")), 6))
    return X.index_distribution(v, "sali", "n").withColumn("cdf", F.round("cdf", 6))


@query("select label as fold, count(*) as n, round(avg(vec_id), 6) as mean, round(median(vec_id), 6) as median, round(stddev_pop(vec_id), 6) as std, label = 3 as is_holdout from embeddings group by label")
def agg22_fold_targets(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("fold"), "vec_id")
    sums = rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("vec_id"), 6).alias("mean"), F.round(F.stddev_pop("vec_id"), 6).alias("std"), F.bool_or(F.col("fold") == 3).alias("is_holdout")
    )
    return with_quantiles(sums, ["fold"], rows, "vec_id", {"median": 0.5}).withColumn("median", F.round("median", 6))


def _folds_sim(asked=""):
    return (
        f"with {_S}, w as (select s.* from s{asked}), p as (select w.k as i, s.k as j, count(*) as c from w join s using (e) where w.k <> s.k group by all), "
        "x as (select i, la.lang as fold, lb.lang as other, c / (a.n + b.n - c) as sim from p join n a on a.k = i join n b on b.k = j join documents la on la.doc_id = i join documents lb on lb.doc_id = j where la.lang <> lb.lang), "
    )


def _across_folds(spark, d, per_fold, asked):
    """Mean similarities of the rows asked for to their five nearest rows of other folds (languages)."""
    return X.nearest_across(hashed(spark, d, {"lang": F.col("lang")}), "doc_id", "items", "lang", asked, 5, per_fold)


@query(
    _folds_sim() + "t as (select i, fold, sim, row_number() over (partition by i order by sim desc) as rn from x), f as (select fold, count(distinct i) as n, median(m) as med from (select i, fold, avg(sim) as m from t where rn <= 5 group by all) group by fold) "
    "select fold, n, round(med, 6) as median_top5, row_number() over (order by med, fold) as distinctness, row_number() over (order by med, fold) = 1 as is_holdout from f"
)
def met15_fold_similarity(spark, d):
    """Per fold: median of its rows' mean similarity to their five nearest rows of all other folds; the most distinct fold is the holdout."""
    rows = _across_folds(spark, d, False, F.lit(True))
    per_fold = with_quantiles(rows.groupBy("fold").agg(F.sum("times").alias("n")), ["fold"], rows, "m", {"mid": 0.5}, "times")
    place = F.row_number().over(Window.orderBy("mid", "fold"))  # one row a fold
    return per_fold.select("fold", "n", F.round("mid", 6).alias("median_top5"), place.alias("distinctness"), (place == 1).alias("is_holdout"))


@query(
    _folds_sim(" where k % 20 = 0") + "t as (select i, fold, other, sim, row_number() over (partition by i, other order by sim desc) as rn from x) "
    "select fold, other, count(distinct i) as n, round(median(m), 6) as median_top5 from (select i, fold, other, avg(sim) as m from t where rn <= 5 group by all) group by fold, other"
)
def met15_fold_pairs(spark, d):
    """The same for each pair of folds, of the rows whose ids are divisible by 20."""
    rows = _across_folds(spark, d, True, F.col("doc_id") % 20 == 0)
    sums = rows.groupBy("fold", "other").agg(F.sum("times").alias("n"))
    return with_quantiles(sums, ["fold", "other"], rows, "m", {"median_top5": 0.5}, "times").withColumn("median_top5", F.round("median_top5", 6))
