"""What round 3 found: results that differed, and jobs that grew faster than their input."""

import math
import random
from itertools import combinations

from pyspark.sql import functions as F

from cribrum.functions import scalars
from cribrum.operators import filters, ranking, routing, similarity, spatial
from cribrum.plans import modelling
from cribrum.sources import readers


def test_profile_counts_all_rows(spark):
    df = spark.range(0, 3000, 1, 1).toDF("v")
    assert {r.valid_rate for r in readers.profile(df, F.col("v") < 1000).collect()} == {1 / 3}


def test_pair_bins_begin_at_their_bounds(spark):
    pairs = spark.createDataFrame([(i / 20, 0.5, 1) for i in range(21)], "sim double, diff double, n long")
    got = {r.bin: r.n for r in similarity.pair_bins(pairs, "sim", "diff", "n").collect()}
    assert got == {i: 1 + (i == 19) for i in range(20)}


def _some_sets(seed):
    """Sets of near copies, a passage that most have, and elements of their own."""
    rng, rows = random.Random(seed), []
    for k in range(120):
        base = [f"b{k % 9}-{i}" for i in range(12)]
        own = [f"o{k}-{i}" for i in range(rng.randrange(6))]
        passage = [f"p{i}" for i in range(8)] if rng.random() < 0.7 else []
        rows.append((k, sorted({*rng.sample(base, rng.randrange(6, 13)), *own, *passage}), "abc"[k % 3]))
    return rows + [(200 + i, rows[i][1], "abc"[i % 3]) for i in range(5)]


def _jaccard(a, b):
    return len({*a} & {*b}) / len({*a} | {*b})


def test_similar_sets_by_classes_are_all_pairs(spark):
    rows = _some_sets(3)
    df = spark.createDataFrame(rows, "k long, items array<string>, fold string")
    for tenths in (3, 6, 7):
        want = {(a[0], b[0]): _jaccard(a[1], b[1]) for a, b in combinations(rows, 2) if 10 * len({*a[1]} & {*b[1]}) >= tenths * len({*a[1]} | {*b[1]})}
        got = {(r.i, r.j): r.sim for r in similarity.similarity_self_join(df, "k", "items", tenths).collect()}
        assert got == want


def test_elements_of_the_same_sets_are_one_row(spark):
    """A passage of 50 elements in 200 sets is 200 rows, where each element was one before."""
    df = spark.range(200).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.xxhash64(i)).alias("s"))
    assert [tuple(r) for r in similarity._shared_elements(df).groupBy("f", "w").count().collect()] == [(200, 50, 200)]


def test_nearest_across_folds_by_brute_force(spark):
    rows = _some_sets(5)
    df = spark.createDataFrame(rows, "k long, items array<string>, fold string")
    for per_fold in (False, True):
        want = []
        for k, items, fold in rows:
            if k % 4 == 0:
                sims = [(other, _jaccard(items, x)) for _, x, other in rows if other != fold and {*items} & {*x}]
                others = sorted({o for o, _ in sims})
                for keep in [[o] for o in others] if per_fold else [others]:
                    best = sorted((s for o, s in sims if o in keep), reverse=True)[:5]
                    if best:
                        want.append((fold, *(keep if per_fold else []), round(sum(best) / len(best), 9)))
        got = []
        for r in similarity.nearest_across(df, "k", "items", "fold", F.col("k") % 4 == 0, 5, per_fold).collect():
            got += [(r.fold, *([r.other] if per_fold else []), round(r.m, 9))] * r.times
        assert sorted(got) == sorted(want)


def test_many_literals_by_their_beginnings(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé") for _ in range(60)) for _ in range(30)] + ["", None, "ab"]
    patterns = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(3, 8))) for _ in range(300)})
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.n for r in filters.literal_hits(df, "text", spark.createDataFrame([(p,) for p in patterns], "p string"), "n", 3, 64).collect()}
    assert sum(len(p.encode()) for p in patterns) > 64 * filters.MOST_BLOCKS
    assert got == {k: sum(p in (t or "") for p in patterns) for k, t in enumerate(texts)}


def test_radius_summary_by_brute_force(spark):
    rng = random.Random(4)
    points = [(i, *(rng.uniform(-1, 1) for _ in range(3))) for i in range(150)] + [(150 + i, 0.5, 0.5, 0.5) for i in range(60)]
    df = spark.createDataFrame([*points, (900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: (r.n, round(r.farthest, 9)) for r in spatial.radius_summary(df, df, "id", 0.4, rows=16).collect()}
    near = {a[0]: [math.dist(a[1:], b[1:]) for b in points if math.dist(a[1:], b[1:]) <= 0.4] for a in points}
    assert got == {k: (len(v), round(max(v), 9)) for k, v in near.items()}


def test_character_shingles_are_counted(spark):
    texts = ["", None, "ab", "abcd", "ABCABCABC", "añb😀añb😀añb", "x" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    want = {k: len({t[i : i + 4] for i in range(max(1, len(t) - 3))}) if t else 0 for k, t in enumerate((t or "").lower() for t in texts)}
    assert {r.k: r.n for r in df.select("k", scalars.count_char_shingles(F.col("text"), 4).alias("n")).collect()} == want


def test_ordered_pairs_with_few_and_with_many_queries(spark, tmp_path, monkeypatch):
    rows = [(i, i % 7, [float(i % 5), 1.0]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted((a, b, la - lb >= 1) for a, la, _ in rows for b, lb, _ in rows if a % 20 == 0 and a != b and a // 20 % 4 == b // 20 % 4)
    for most in (modelling._FEW_QUERIES, 1):
        monkeypatch.setattr(modelling, "_FEW_QUERIES", most)
        assert sorted(tuple(r) for r in modelling.jon11_ordered_pairs(spark, str(tmp_path)).collect()) == want


def test_ranks_of_few_and_of_many_values(spark, monkeypatch):
    """A value that half of the rows have is looked up where they are, or in a table; ranks are the same."""
    df = spark.range(400).select("id", F.when(F.col("id") % 10 != 0, (F.col("id") % 2).cast("double")).alias("a"), (F.col("id") * 7 % 400).cast("double").alias("b"))
    out = []
    for most in (10_000, 100, 0):
        monkeypatch.setattr(ranking, "FEW_VALUES", most)
        both = ranking.average_ranks(df, {"a": "ra", "b": "rb"}).collect()
        alone = {r.id: r.ra for r in ranking.average_ranks(df, {"a": "ra"}).collect()}
        assert {r.id: r.ra for r in both} == alone
        out.append(sorted((r.id, r.ra, r.rb) for r in both))
    assert out[0] == out[1] == out[2] and out[0][2][1] == 80.5 and out[0][0][1] is None


def test_blocks_of_vectors_meet_one_at_a_time(spark):
    """The plan has a group for each meeting of blocks, not batches of many."""
    df = spark.range(100).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    near = similarity.nearest_rows(df, df.where("id % 20 = 0"), "id", "v", 3, block=16)
    assert "FlatMapGroupsInArrow" in near._jdf.queryExecution().toString()
    for r in near.where("place = 1").collect():
        assert abs(r.sim - max(math.cos(r["query"] - i) for i in range(100) if i != r["query"])) < 1e-9


_ODD = ["", None, " ", "One", "one  TWO", "a b c a b c a", "a\tb\x0bc\nd", "a\xa0b c d\x1ce f", "\u0130X Y z ÄÖ", "x\x85y z w"]


def test_known_shingles_and_runs_are_those_of_all(spark):
    df = spark.createDataFrame(list(enumerate(_ODD)), "k long, text string")
    every = {r.k: r.s for r in df.select("k", scalars.shingles(F.col("text")).alias("s")).collect()}
    known = {s for v in every.values() for s in v if len(s) % 2} | {"not there"}
    got = {r.k: (r.f.n, sorted(r.f.held)) for r in df.select("k", scalars.known_shingles(F.col("text"), known).alias("f")).collect()}
    assert got == {k: (len(v), sorted({*v} & known)) for k, v in every.items()}
    runs = {"a", "a b", "b c a", "one two", "two", "c d", "a b c a"}
    words = {r.k: r.w for r in df.select("k", F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), "").alias("w")).collect()}
    got = {r.k: sorted(r.f) for r in df.select("k", scalars.known_runs(F.col("text"), runs).alias("f")).collect()}
    assert got == {k: sorted(r for r in runs if f" {r} " in f" {' '.join(w)} ") for k, w in words.items()}


def test_routing_looks_up_few_and_many_references_alike(spark, monkeypatch):
    """And of a text's n-grams only those of references become rows."""
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(100, None), (101, "A  b\tC")]
    refs = [(i, "AB"[i % 2] + "|Z" * (i % 3 == 0), " ".join(rng.choice("abcde") for _ in range(1 + i % 6))) for i in range(24)]
    df, known = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(refs, "ref_id long, site string, pattern string")
    out = []
    for most in (100_000, 0):
        monkeypatch.setattr(similarity, "KNOWN_SHINGLES", most)
        monkeypatch.setattr(filters, "KNOWN_HEADS", most)
        out.append(sorted(tuple(r) for r in routing.route_scores(df, "k", "text", known).collect()))
        held = sorted((r.k, r.ref_id) for r in filters.contained_references(df, "k", "text", known).collect())
        assert held == sorted((k, i) for k, t in texts for i, _, p in refs if f" {p} " in f" {' '.join((t or '').lower().split())} ")
    assert out[0] == out[1] and out[0]
    monkeypatch.setattr(similarity, "KNOWN_SHINGLES", 100_000)
    found = similarity.shared_shingles(df.select(F.col("k").alias("l"), "text"), known.select(F.col("ref_id").alias("r"), F.col("pattern").alias("text")))
    assert "array_join" not in found._jdf.queryExecution().executedPlan().toString()


def _components(rows):
    """Per group and part: the least part of its component, by joining until nothing changes."""
    label = {(g, p): p for g, p, _ in rows}
    while True:
        least = {}
        for g, p, e in rows:
            least[g, e] = min(least.get((g, e), p), label[g, p])
        now = {k: min(least[g, e] for g, p, e in rows if (g, p) == k) for k in label}
        if now == label:
            return sorted((g, p, c) for (g, p), c in label.items())
        label = now


def test_components_in_many_small_tasks(spark, monkeypatch):
    """More rows are more tasks, elements of many parts go in lots, and labels are the same: chains, a hot element and groups that end early."""
    rng = random.Random(8)
    rows = [(0, p, p + i) for p in range(40) for i in (0, 1)] + [(1, p, 7) for p in range(60)] + [(1, 100 + p, 900 + p) for p in range(5)] + [(1, 59, 901)]
    rows += [(g, rng.randrange(30), rng.randrange(40)) for g in range(2, 9) for _ in range(25)]
    rows = sorted({*rows})
    df = spark.createDataFrame(rows, "g long, p long, e long").localCheckpoint()
    want = _components(rows)
    for task_rows, lot_rows, few_groups in ((500_000, 100_000, 500_000), (20, 8, 500_000), (20, 8, 0)):
        monkeypatch.setattr(spatial, "TASK_ROWS", task_rows)
        monkeypatch.setattr(spatial, "LOT_ROWS", lot_rows)
        monkeypatch.setattr(spatial, "BROADCAST_GROUPS", few_groups)
        assert sorted(tuple(r) for r in spatial._spread_labels(spatial._in_lots(df)).select("g", "p", "c").collect()) == want
    assert spatial._tasks(df) == -(-len(rows) // 20) > 4
    assert spatial._in_lots(df).groupBy("g", "e").count().agg(F.max("count")).first()[0] < 60
