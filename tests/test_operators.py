"""Operators on small tables: nulls, ties, empty input, one class."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cribrum.functions import scalars as S
from cribrum.operators import filters as X, metrics as M, models, ranking as K, replicates as R, similarity as Sim, spatial
from cribrum.sources import readers


def test_rank_norm_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 3.0), (4, None), (5, float("nan"))], "id int, s double")
    got = {r.id: r.rn for r in K.rank_norm(df, "s", "rn").collect()}
    assert got == {1: pytest.approx(1 / 3), 2: pytest.approx(2.5 / 3), 3: pytest.approx(2.5 / 3), 4: None, 5: None}


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(300).select("id", (F.col("id") * 37 % 101).cast("double").alias("s"))
    a = sorted(map(tuple, K.ordinal_rank(df.repartition(1), "s", "id", "p").select("id", "p").collect()))
    b = sorted(map(tuple, K.ordinal_rank(df.repartition(7), "s", "id", "p").select("id", "p").collect()))
    assert a == b and sorted(p for _, p in a) == list(range(1, 301))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, y int, s double")
    assert K.rank_norm(empty, "s", "rn").count() == 0
    assert M.auroc(empty, "y", "s").first().auroc is None
    assert R.distribution(empty, "s").first()["count"] == 0


def test_auroc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert M.auroc(df, "y", "s").first().auroc is None


def test_quantile_labels_reject_nulls_and_bad_q(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id int, v double")
    with pytest.raises(ValueError):
        X.quantile_labels(df, "v", 1.0)
    with pytest.raises(Exception):
        X.quantile_labels(df, "v", 0.5).collect()


def test_gray_zone_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert [(r.v, r.label) for r in X.gray_zone(df, "v", 2.0, 3.0).orderBy("v").collect()] == [(1.0, False), (4.0, True)]


def test_literal_filter_of_null(spark):
    df = spark.createDataFrame([("a.b cd",), (None,), ("axb cd",)], "t string")
    assert [r[0] for r in df.select(X.any_literal(F.col("t"), ["a.b c", "x"])).collect()] == [True, False, False]


def test_tanimoto_of_empty_sets(spark):
    row = spark.range(1).select(S.tanimoto(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("t")).first()
    assert row.t == 0.0


def test_similarity_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    sets = [(i, [str(x) for x in rng.choice(14, rng.integers(1, 8), replace=False)]) for i in range(60)]
    df = spark.createDataFrame(sets, "k long, items array<string>")
    for tenths in (3, 5, 8):
        got = {(r.i, r.j) for r in Sim.similarity_self_join(df, "k", "items", tenths).collect()}
        want = {(i, j) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) * 10 >= tenths * len(set(a) | set(b))}
        assert got == want


def test_nearest_rows_equal_brute_force(spark):
    x = np.random.default_rng(2).normal(size=(90, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in Sim.nearest_rows(df, df.where("id % 20 = 0"), "id", "v", 3, block=16).collect():
        got.setdefault(r["query"], set()).add(r.neighbour)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T - 9 * np.eye(90)
    assert got == {q: set(np.argsort(-sim[q])[:3].tolist()) for q in range(0, 90, 20)}


def test_components(spark):
    rows = [("g", 1, 1), ("g", 2, 1), ("g", 2, 2), ("g", 3, 2), ("g", 4, 9), ("h", 1, 1)]
    df = spark.createDataFrame(rows, "g string, p int, e int")
    assert {r.g: r.largest for r in spatial.largest_components(df, "g", "p", "e", 1).collect()} == {"g": 3, "h": 0}


def test_signed_rank_p_is_exact_for_small_n():
    assert M.signed_rank_p(1, 1.0, 0.0, 0.0) is None
    assert M.signed_rank_p(5, 15.0, 0.0, 0.0) == pytest.approx(0.0625)


def test_studentized_range():
    assert M.studentized_range_cdf(3.877, 3, 10) == pytest.approx(0.95, abs=3e-3)


def test_sphere_clusters(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "i long, j long")
    got = {r.id: r.cluster for r in models.sphere_clusters(pairs, nodes, "id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}


def test_greedy_folds(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2, "c string")
    assert {r.c: r.fold for r in models.pack_folds(spark, df, "c", 2).collect()} == {"a": 0, "b": 1, "c": 1}


def test_load_errors(spark, tmp_path):
    with pytest.raises(readers.DataError):
        readers.load(spark, str(tmp_path / "none.parquet"), [])
    spark.range(1).write.parquet(str(tmp_path / "t.parquet"))
    with pytest.raises(readers.DataError):
        readers.load(spark, str(tmp_path / "t.parquet"), ["x"])


def test_quantiles_are_those_of_numpy(spark):
    import numpy as np

    from cribrum.operators.replicates import quantiles

    rng = np.random.default_rng(3)
    values = [float(x) for x in rng.integers(0, 40, 301)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = quantiles(df, "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).first()
    assert np.allclose(list(got), np.quantile(values, [0, 0.25, 0.5, 0.9, 1]))
    assert list(quantiles(df.where("v is null"), "v", {"a": 0.5}).first()) == [None]


def test_row_numbers_run_through(spark):
    from cribrum.operators.ranking import row_numbers

    df = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(100)], "k long, v long").repartition(5)
    got = [r.n for r in row_numbers(df, [F.desc_nulls_last("v"), F.asc("k")], "n").orderBy(F.desc_nulls_last("v"), "k").collect()]
    assert got == list(range(100))
    assert row_numbers(df.limit(0), ["k"], "n").count() == 0


def test_representatives_of_small_and_large_groups(spark):
    from cribrum.operators.models import attach_folds, cluster_representatives

    rows = [("small", i, [float(i), 0.0], 1.0) for i in range(2)] + [("large", 10 + i, [float(100 * (i % 3)), float(i % 2)], float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, k long, v array<double>, s double")
    got = {(r.g, r.k) for r in cluster_representatives(df, "g", "k", "v", "s", 3, 5).collect()}
    assert got == {("small", 0), ("small", 1), ("large", 19), ("large", 20), ("large", 21)}
    with pytest.raises(ValueError):
        attach_folds(df, df.where("k > 3").select("k", F.lit(0).alias("fold")), "k")
