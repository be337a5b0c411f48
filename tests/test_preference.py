"""Boosted trees over pairs that are in no table, against Spark's trainer over a table of the pairs."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cribrum.functions.scalars import differences
from cribrum.operators import models as X, preference as P, ranking as K
from cribrum.operators.lineage import cut, shared_folder
from cribrum.plans import modelling


def test_pairs_are_in_no_table(spark, monkeypatch):
    """3,000 pairs of 500 rows were written with their differences."""
    monkeypatch.setattr(X, "TREES", 1)
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    row = modelling.mdl16_pairwise_preference(spark, "/root/testdata/sf0.001").first()
    assert row.n == 25
    assert max(spark.read.parquet(f"file://{p}").count() for p in set(folder.iterdir()) - before) <= 500


def test_hash_is_that_of_columns(spark):
    rows = [(a, b) for a in (0, 1, -5, 2**62) for b in (7, -(2**63), 123456789)]
    want = [r.h % 2**64 for r in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    a, b = (np.array(x, np.int64).view(np.uint64) for x in zip(*rows))
    assert P.hash_longs(b, P.hash_longs(a, np.uint64(42))).tolist() == want


def _rows(spark, above):
    """Labels that a feature tells in part; those of queries are higher by ``above``."""
    rng, rows = random.Random(above), []
    for k in range(800):
        x = [rng.gauss(0, 1) for _ in range(5)]
        label = None if k % 97 == 5 else round(4 + 2 * x[0] - x[3] + rng.gauss(0, 1)) + above * (k % 20 == 0)
        rows.append((k, label, x, k // 20 % 4, k // 80 % 4))
    return cut(spark.createDataFrame(rows, "k long, label int, x array<double>, grp int, fold int"))


@pytest.mark.parametrize("above,part", [(0, 2048), (0, 64), (4, 64)])
def test_scores_are_those_of_sparks_trees(spark, monkeypatch, above, part):
    """The same pairs, weights, candidates and trees, whether negatives are chosen or all taken, in one block a group or in many."""
    monkeypatch.setattr(P, "ROW_PART", part)
    monkeypatch.setattr(P, "QUERY_PART", part // 16)
    df = _rows(spark, above)
    asked, folds = F.col("k") % 20 == 0, [0, 1, 2, 3]
    a, b = df.where(asked).toDF("a", "la", "va", "grp", "fold"), df.select("k", "label", "x", "grp").toDF("b", "lb", "vb", "grp")
    pairs = cut(a.join(b, "grp").where("a <> b").select("a", "la", "fold", (F.col("la") - F.col("lb") >= 1).cast("int").alias("y"), differences(F.col("va"), F.col("vb")).alias("features"), F.xxhash64("a", "b").alias("k")))
    _, models = X.cross_validate(X.vectors(K.balanced(pairs, "y", "k", 3)), "k", "y", "fold", folds, trees=3)
    scored = X.ensemble_score(X.vectors(pairs), models).groupBy("a").agg(F.avg(F.get("members", "fold")).alias("score"), F.first("la").alias("label"))
    want = {r.a: (r.score, r.label) for r in scored.collect()}
    got = {r.k: (r.score, r.label) for r in P.preference_scores(df, "k", "label", "x", "grp", "fold", asked, folds, 3, 3).collect()}
    assert got.keys() == want.keys() and len(got) == 40
    for k, (score, label) in want.items():
        assert got[k][0] == pytest.approx(score, abs=1e-6) and got[k][1] == label


def test_candidates_are_quantiles_by_weight():
    values = np.repeat(np.arange(100.0), 3)
    assert P.quantile_splits(values[:9], np.ones(9), 31).tolist() == [0.5, 1.5]
    assert P.quantile_splits(values, np.ones(300), 3).tolist() == [24.5, 49.5, 74.5]
