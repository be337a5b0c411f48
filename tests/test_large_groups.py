"""Operators for large groups, crowded keys and arriving files against brute force."""

import collections
import itertools
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cribrum.operators import filters, metrics, models, ranking, replicates, similarity, spatial
from cribrum.sources import readers, writers
from cribrum.streaming import funnel, parts


def average_ranks(values):
    """1, 2, ... with ties shared; None for None and NaN."""
    good = sorted(v for v in values if v is not None and v == v)
    return [None if v is None or v != v else np.mean([i + 1 for i, x in enumerate(good) if x == v]) for v in values]


def scores(n):
    rng = np.random.default_rng(1)
    a = [None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(x) for i, x in enumerate(rng.integers(0, 9, n))]
    b = [1.0 if i % 3 == 0 else float(x) for i, x in enumerate(rng.normal(0, 1, n))]
    return [(i, x, y, None) for i, (x, y) in enumerate(zip(a, b))]


def test_ranks_of_many_columns_at_once(spark):
    table = scores(150)
    df = spark.createDataFrame(table, "k long, a double, b double, c double").repartition(3)
    got = {r.k: r for r in ranking.average_ranks(df, {"a": "ra", "b": "rb", "c": "rc"}).collect()}
    for (k, *_), ra, rb in zip(table, average_ranks([r[1] for r in table]), average_ranks([r[2] for r in table])):
        assert (got[k].ra, got[k].rb, got[k].rc) == (ra, rb, None)
    one = {r.k: r.r for r in ranking.rank_norm(df, "a", "r").collect()}
    n = sum(r[1] is not None and r[1] == r[1] for r in table)
    assert all(one[k] == (None if ra is None else pytest.approx(ra / n)) for (k, *_), ra in zip(table, average_ranks([r[1] for r in table])))
    assert ranking.rank_norms(df.limit(0), {"a": "x", "b": "y"}).count() == 0


@pytest.mark.parametrize("names", [{"a": "x"}, {"a": "x", "b": "y", "c": "z"}])
def test_ranks_scan_their_input_once(spark, tmp_path, names):
    spark.createDataFrame(scores(30), "k long, a double, b double, c double").write.parquet(str(tmp_path / "t"))
    out = ranking.rank_norms(spark.read.parquet(str(tmp_path / "t")), names)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("k#") > 0
    assert out._jdf.queryExecution().executedPlan().toString().count(str(tmp_path / "t")) <= 1


def test_quantiles_of_groups(spark):
    """A group with most of the rows, a null group, one without values; weights count as repeats."""
    rng = np.random.default_rng(2)
    rows = [("big", float(x), 1) for x in rng.normal(0, 1, 400)] + [(None, float(x), int(w)) for x, w in zip(rng.integers(0, 5, 40), rng.integers(1, 9, 40))] + [("one", 3.0, 2), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9}
    for weight in (None, "w"):
        got = {r.g: list(r)[1:] for r in replicates.group_quantiles(df, ["g"], "v", wanted, weight).collect()}
        assert set(got) == {"big", None, "one"}
        for g in got:
            values = np.repeat([v for h, v, _ in rows if h == g], [w if weight else 1 for h, _, w in rows if h == g])
            assert np.allclose(got[g], np.quantile(values, list(wanted.values())))
    full = replicates.with_quantiles(df.select("g").distinct(), ["g"], df, "v", {"m": 0.5})
    assert {r.g: r.m for r in full.collect()}["none"] is None and full.count() == 4


def test_large_groups_are_spread_over_tasks(spark):
    """Of 4,000 rows of one group no part of the ranking has more than a few ranges' share."""
    df = spark.range(4000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 4001).cast("double").alias("v"))
    counts = df.groupBy("v").count()
    sizes = [r["count"] for r in counts.groupBy(ranking.range_of(counts, "v")).count().collect()]
    assert len(sizes) >= 16 and max(sizes) <= 4000 / 8


def test_weighted_pairs_are_the_pairs(spark):
    rng = np.random.default_rng(3)
    base = [[f"s{k}e{i}" for i in range(20)] for k in range(4)]
    rows = []
    for i in range(60):
        items = list(base[i % 4])
        if i % 3 == 0:
            items[int(rng.integers(20))] = f"x{i % 2}"
        rows.append((i, items, float(i % 5), None if i % 4 == 0 else "ab"[i % 2]))
    df = spark.createDataFrame(rows, "k long, items array<string>, y double, g string")
    want = collections.Counter()
    for r in similarity.similarity_self_join(df, "k", "items", 3).collect():
        a, b = rows[r.i], rows[r.j]
        want[round(r.sim, 9), abs(a[2] - b[2]), tuple(sorted(map(str, (a[3], b[3]))))] += 1
    got = collections.Counter()
    for r in similarity.weighted_pairs(df, "k", "items", 3, ["y", "g"]).collect():
        got[round(r.sim, 9), abs(r.y_i - r.y_j), tuple(sorted(map(str, (r.g_i, r.g_j))))] += r.n
    assert got == want and sum(got.values()) > 300


def test_a_million_copies_make_no_pairs(spark):
    """Counts of 10**12 pairs from one class of copies: one row."""
    df = spark.range(1_000_000).select(F.col("id").alias("k"), F.array(F.lit("a"), F.lit("b")).alias("items"), F.lit(1.0).alias("y"))
    assert [tuple(r) for r in similarity.weighted_pairs(df, "k", "items", 7, ["y"]).collect()] == [(1.0, 1.0, 1.0, 1_000_000 * 999_999 // 2)]


def tau_b(a, b):
    s = na = nb = 0
    for (x, y), (u, v) in itertools.combinations(zip(a, b), 2):
        s, na, nb = s + np.sign(x - u) * np.sign(y - v), na + (x != u), nb + (y != v)
    return s / np.sqrt(float(na) * nb) if na and nb else None


@pytest.mark.parametrize("kind", ["plain", "ties", "hot", "constant", "two"])
def test_kendall_of_a_table(spark, kind):
    rng = np.random.default_rng(4)
    n = 2 if kind == "two" else 400
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    if kind == "ties":
        a, b = np.floor(3 * a), np.floor(2 * b)
    if kind == "hot":
        a[: n // 3], b[n // 4 : n // 2] = 0.5, -1.0
    if kind == "constant":
        a[:] = 1.0
    rows = [(float(x), float(y)) for x, y in zip(a, b)] + [(None, 1.0), (2.0, None), (float("nan"), 1.0)]
    got = metrics.kendall(spark.createDataFrame(rows, "a double, b double").repartition(3), "a", "b").first()
    want = tau_b(a, b)
    assert got.n == n and (got.tau_b is None if want is None else got.tau_b == pytest.approx(want, abs=1e-12))


def test_kendall_of_nothing(spark):
    assert tuple(metrics.kendall(spark.createDataFrame([], "a double, b double"), "a", "b").first()) == (None, 0)


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_radius_join_with_crowded_cells(spark, cell_rows):
    """Nine in ten points in one cell, many of them at one place; nulls and NaN pair with nothing."""
    rng = np.random.default_rng(5)
    points = [(i, *(float(x) for x in rng.uniform(0.1, 0.9, 3))) for i in range(60)]
    points += [(100 + i, 0.5, 0.5, 0.5) for i in range(30)] + [(200 + i, *(float(x) for x in rng.uniform(-3, 3, 3))) for i in range(10)]
    schema = "k long, x double, y double, z double"
    df = spark.createDataFrame([*points, (300, None, 0.0, 0.0), (301, float("nan"), 0.0, 0.0)], schema)
    got = sorted((r.l_k, r.r_k) for r in spatial.radius_join(df, df, 1.0 / 3, cell_rows).collect())
    want = sorted((a[0], b[0]) for a in points for b in points if np.linalg.norm(np.subtract(a[1:], b[1:])) <= 1.0 / 3)
    assert got == want
    assert spatial.radius_join(df.limit(0), df, 1.0, cell_rows).count() == 0


def largest(rows, shared):
    out = {}
    for g in {g for g, *_ in rows}:
        sets = collections.defaultdict(set)
        for h, p, e in rows:
            if h == g and p is not None and e is not None:
                sets[p].add(e)
        comp = {p: p for p in sets}
        for _ in sets:
            for a, b in itertools.combinations(sets, 2):
                if len(sets[a] & sets[b]) >= shared:
                    comp[a] = comp[b] = min(comp[a], comp[b])
        sizes = collections.Counter(comp.values())
        out[g] = max((n for n in sizes.values() if n > 1), default=0)
    return out


@pytest.mark.parametrize("shared", [1, 2, 3])
def test_components_over_shared_elements(spark, shared):
    """With an element that all parts of a group have, long chains, lone parts and nulls."""
    rng = np.random.default_rng(6)
    rows = [("hot", p, e) for p in range(40) for e in (0, 100 + p)]
    rows += [("chain", p, e) for p in range(25) for e in (3 * p, 3 * p + 1, 3 * p + 2, 3 * p + 3, 3 * p + 4)]
    rows += [("any", int(p), int(e)) for p, e in rng.integers(0, 12, (45, 2))] + [("lone", 1, 1), ("null", None, 1), ("null", 1, None)]
    df = spark.createDataFrame(rows, "g string, p long, e long")
    assert {r.g: r.largest for r in spatial.largest_components(df, "g", "p", "e", shared).collect()} == largest(rows, shared)


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_many_literals(spark, block):
    patterns = ["abab", "ab a", "été!", "a", "null", "zzzz", "bab", "abab", "longer than any text here", None]
    texts = [(1, "ababab a"), (2, None), (3, ""), (4, "un été! null"), (5, "ABAB"), (6, "a" * 5000 + "zzzz")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "k long, text string, p string").repartition(2)
    got = {r.k: r.n for r in filters.literal_hits(df, "text", spark.createDataFrame([(p,) for p in patterns], "pattern string"), "n", 3, block).collect()}
    known = {p for p in patterns if p and len(p) >= 3}
    assert got == {i: sum(p in (t or "") for p in known) for i, t in texts}
    assert [r.n for r in filters.literal_hits(df, "text", spark.createDataFrame([], "p string"), "n").collect()] == [0] * 6


def test_headers_per_file(spark, tmp_path):
    """Other headers at other lines; data that repeats lines above a header stays; quotes, blank lines, short lines."""
    (tmp_path / "a.csv").write_text('note\nnote,\n"Compound  ID",x,"KD Value, uM"\nc1,1,2.5\n\nnote,\n"c,2",1,"7"\nc3\n')
    (tmp_path / "b.csv").write_text("Sample,Kd value error,kd value\ns1,9,1\nSample,Kd value error,kd value\n")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.csv").write_text("\n\n\n\nkd value a,sample,compound id,kd value b\nn/a,s2,,4\n3,,c9,5\n")
    out = readers.read_sheets(spark, str(tmp_path), ["compound id", "sample"], "kd value", ["error"])
    got = sorted((r.file.rsplit("/", 1)[1], str(r.id), r.value) for r in out.collect())

    by_file = collections.defaultdict(list)
    for file, i, v in got:
        by_file[file].append((i, v))
    assert by_file["b.csv"] == [("Sample", None), ("s1", 1.0)] and by_file["d.csv"] == [("c9", 3.0), ("s2", 4.0)]
    assert [i for i, _ in by_file["a.csv"]] == ["c,2", "c1", "c3", "note"]
    one = readers.read_below_header(spark, str(tmp_path / "b.csv"), ["sample"])
    assert one.columns == ["Sample", "Kd value error", "kd value"] and one.count() == 2
    (tmp_path / "e.csv").write_text("1,2\n3,4\n")
    with pytest.raises(readers.DataError, match="e.csv"):
        readers.read_sheets(spark, str(tmp_path), ["compound id", "sample"], "kd value", ["error"])


def test_clusters_of_all_groups(spark):
    """Each group as k-means by itself gives it; a null group, a small one, a row without a vector."""
    rng = np.random.default_rng(7)
    rows = [(g, 100 * j + i, [float(x) for x in rng.normal(0, 1, 3)]) for j, (g, n) in enumerate((("a", 30), (None, 25), ("small", 2), ("same", 6))) for i in range(n)]
    rows = [(g, k, [1.0, 1.0, 1.0] if g == "same" else v) for g, k, v in rows]
    df = spark.createDataFrame([*rows, ("a", 999, None)], "g string, k long, v array<double>").repartition(3)
    got = {r.k: (r.g, r.cluster) for r in models.group_clusters(df, "g", "k", "v", 4, 5, F.col("k")).collect()}
    want = {}
    for g in {g for g, *_ in rows}:
        keys = sorted(k for h, k, _ in rows if h == g)
        x = np.array([next(v for _, k2, v in rows if k2 == k) for k in keys])
        if len(keys) <= 4:
            want |= {k: (g, i) for i, k in enumerate(keys)}
            continue
        centres = x[:4].copy()
        for _ in range(5):
            near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(4)])
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        want |= {k: (g, int(c)) for k, c in zip(keys, near)}
    assert got == want
    assert models.group_clusters(df.limit(0), "g", "k", "v", 4, 5, F.col("k")).count() == 0


SCHEMA = "k long, v double"



def steps():
    return [("low", F.col("v") >= 2), ("high", F.col("v") < 90)]


def arrive(spark, path, n):
    """One file of 100 rows, later than those before."""
    spark.range(100 * n, 100 * n + 100).selectExpr("id as k", "double(id % 100) as v").coalesce(1).write.mode("append").parquet(path)


def survivors(spark, target):
    return sorted(r.k for r in parts.Parts(spark, target).rows(SCHEMA).collect())


def expected(files):
    return [k for k in range(100 * files) if 2 <= k % 100 < 90]


def test_roll_ups_have_their_rows(spark, tmp_path):
    path, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n in range(7):
        arrive(spark, path, n)
    state = parts.run_to_parts(funnel.arriving(spark, path, SCHEMA, 1), steps(), target, checkpoint, 250)
    assert [(x["shards"], x["raw"], x["rows"]) for x in state.rollups] == [(3, 300, 264)] * 2 and [x["raw"] for x in state.shards] == [100]
    assert state.counters == {"raw": 700, "fail_low": 14, "fail_high": 70, "out": 616} and survivors(spark, target) == expected(7)
    # Nothing new: nothing changes.
    assert parts.run_to_parts(funnel.arriving(spark, path, SCHEMA, 1), steps(), target, checkpoint, 250) == state
    store = parts.Parts(spark, target)
    done = store.finish(1, checkpoint)
    assert [x["raw"] for x in done.rollups] == [300, 300, 100] and done.final["rows"] == 616 and not os.path.exists(checkpoint)
    assert survivors(spark, target) == expected(7) and store.stale() == [] and len(os.listdir(f"{target}/data")) == 1
    assert store.finish(1) == done
    with pytest.raises(ValueError, match="finished"):
        parts.run_to_parts(funnel.arriving(spark, path, SCHEMA, 1), steps(), target, checkpoint, 250)
    again = parts.run_to_parts(funnel.arriving(spark, path, SCHEMA, 1), steps(), target, checkpoint, 250, fresh=True)
    assert again.counters == state.counters and survivors(spark, target) == expected(7)


KILLED = """
import os, sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import SparkSession
from cribrum.streaming import funnel, parts
from test_large_groups import SCHEMA, steps
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
parts.run_to_parts(funnel.arriving(spark, {path!r}, SCHEMA, 1), steps(), {target!r}, {checkpoint!r}, 150, before_commit=lambda n: os._exit(9) if n == {at} else None)
"""


def test_a_killed_process_leaves_nothing_that_counts(spark, tmp_path):
    """The whole process ends between the write of a shard (and a roll-up) and its commit; the next run goes on exactly."""
    path, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n in range(4):
        arrive(spark, path, n)
    here = os.path.dirname(__file__)
    code = KILLED.format(root=os.path.dirname(here), tests=here, path=path, target=target, checkpoint=checkpoint, at=1)
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=240)
    assert run.returncode == 9, run.stderr[-2000:]
    store = parts.Parts(spark, target)
    assert survivors(spark, target) == expected(1) and len(store.stale()) == 2
    state = parts.run_to_parts(funnel.arriving(spark, path, SCHEMA, 1), steps(), target, checkpoint, 150)
    assert store.stale() == [] and survivors(spark, target) == expected(4)
    assert state.counters["raw"] == 400 and [x["raw"] for x in state.rollups] == [200, 200]


def test_a_batch_that_was_committed_is_not_written_again(spark, tmp_path):
    """The stop comes after the commit of the manifest and before that of the stream."""
    path, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n in range(3):
        arrive(spark, path, n)
    commit = parts.Parts.commit

    def commit_and_stop(self, state):
        commit(self, state)
        if state.batch == 1:
            raise RuntimeError("stopped on purpose")

    parts.Parts.commit = commit_and_stop
    try:
        with pytest.raises(StreamingQueryException):
            parts.run_to_parts(funnel.arriving(spark, path, SCHEMA, 1), steps(), target, checkpoint, 1000)
    finally:
        parts.Parts.commit = commit
    state = parts.run_to_parts(funnel.arriving(spark, path, SCHEMA, 1), steps(), target, checkpoint, 1000)
    assert [x["raw"] for x in state.shards] == [100] * 3 and survivors(spark, target) == expected(3)


def test_two_writers_cannot_both_commit(spark, tmp_path):
    store = parts.Parts(spark, str(tmp_path / "t"))
    first, second = store.state(), store.state()
    store.commit(first)
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(second)
    assert store.state() == first


def test_roll_up_of_a_folder(spark, tmp_path):
    for n in range(6):
        spark.range(90).coalesce(1).write.mode("append").parquet(str(tmp_path / "shards"))
    log = writers.roll_up(spark, str(tmp_path / "shards"), str(tmp_path / "out"), 100)
    assert sorted((r.rollup, r.shards, r.rows) for r in log.collect()) == [(0, 2, 180), (1, 2, 180), (2, 2, 180)]
    assert writers.row_groups(spark.read.parquet(str(tmp_path / "shards"))).agg(F.count("file"), F.sum("groups")).first()[:] == (6, 6)


def test_quota_keeps_the_first_of_each_group(spark):
    df = spark.createDataFrame([(g, i, q) for g, q in (("a", 3), ("b", 0), ("c", 9)) for i in range(5)], "g string, k long, q int")
    for most in (None, 9):
        got = sorted((r.g, r.k) for r in ranking.top_per_group(df, ["g"], [F.desc("k")], F.col("q"), most).collect())
        assert got == [("a", 2), ("a", 3), ("a", 4), *(("c", i) for i in range(5))]


@pytest.mark.parametrize("n", [2, 5, 9])
def test_signed_rank_p_by_all_signs(n):
    """Every assignment of signs to the ranks, counted."""
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    total = n * (n + 1) // 2
    for w in range(total // 2 + 1):
        want = min(1.0, 2 * sum(s <= w for s in sums) / 2**n)
        assert metrics.signed_rank_p(n, float(w), float(total - w), 0.0) == pytest.approx(want)


@pytest.mark.parametrize("k, dof, q", [(3, 10, 3.877), (4, 20, 3.958), (5, 30, 4.102), (2, 60, 2.829), (10, 120, 4.560)])
def test_studentized_range_as_tabulated(k, dof, q):
    assert metrics.studentized_range_cdf(q, k, dof) == pytest.approx(0.95, abs=2e-3)


def test_pairwise_means_by_hand(spark):
    """Two groups: Tukey's test is Student's, and the range of two is the difference times the square root of two."""
    a, b = [1.0, 2.0, 3.0, 4.0], [3.0, 4.0, 5.0, 6.5]
    row = metrics.tukey(spark, spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double"), "g", "v").first()
    pooled = (3 * np.var(a, ddof=1) + 3 * np.var(b, ddof=1)) / 6
    t = (np.mean(b) - np.mean(a)) / np.sqrt(pooled / 2)
    # P(|t| > x) of Student's distribution with six degrees of freedom, by quadrature.
    x = np.linspace(0, abs(t), 20001)
    density = (1 + x * x / 6) ** -3.5 * 15 / 16 / np.sqrt(6)
    assert row.mean_diff == pytest.approx(2.125) and row.p == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=5e-3)
    assert row.low < row.mean_diff < row.high and row.reject == (row.p < 0.05)


def test_sphere_clusters_by_brute_force(spark):
    """Leaders by degree, then key, one after another, as a loop takes them."""
    rng = np.random.default_rng(8)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 25, (40, 2)).tolist() if p[0] != p[1]}
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    order, cluster = sorted(range(25), key=lambda i: (-len(near[i]), i)), {}
    got = {r.id: r.cluster for r in models.sphere_clusters(spark.createDataFrame(sorted(pairs), "i long, j long"), spark.range(25), "id").collect()}
    leaders = {c for c in got.values()}
    # Every row is its leader or beside it, leaders aren't beside each other, and no row outranks its leader's claim.
    assert set(got) == set(range(25)) and all(got[c] == c for c in leaders)
    assert all(c == i or c in near[i] for i, c in got.items()) and not any(a in near[b] for a in leaders for b in leaders)
    rank = {i: n for n, i in enumerate(order)}
    assert all(rank[got[i]] == min(rank[c] for c in leaders & (near[i] | {i})) or i in leaders for i in got)


def test_all_pairs_of_packed_fingerprints(spark):
    from cribrum.functions import scalars as S

    rng = np.random.default_rng(9)
    bits = [sorted({int(x) for x in rng.integers(0, 128, int(rng.integers(1, 30)))}) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(bits)), "k long, b array<int>").select("k", S.pack_bits(F.col("b"), 128).alias("w"))
    got = {(r.i, r.j): r.sim for r in similarity.all_pairs(df, "k", "w").collect()}
    want = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for (i, a), (j, b) in itertools.combinations(enumerate(bits), 2)}
    assert got == pytest.approx(want)


def test_space_folds_by_brute_force(spark):
    """The plane is that of the singular vectors, up to signs; each row is in the fold of the nearest centre; no fold is empty."""
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(c, 0.3, (30, 5)) for c in ([0] * 5, [4, 0, 0, 0, 0], [0, 6, 0, 0, 0])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    got = sorted(models.space_folds(df, "k", "v", 3, 11).collect())
    plane, fold = np.array([r[2:] for r in got]), np.array([r[1] for r in got])
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(plane), np.abs(x @ axes[:2].T), atol=1e-6)
    centres = np.array([plane[fold == f].mean(0) for f in range(3)])
    assert (((plane[:, None] - centres[None]) ** 2).sum(2).argmin(1) == fold).all() and sorted(np.bincount(fold)) == [30, 30, 30]
    with pytest.raises(Exception):
        models.space_folds(df.limit(2), "k", "v", 3, 11).collect()


def two_classes(spark, n=160):
    rng = np.random.default_rng(11)
    rows = [(i, i % 4, int(y), [float(3 * y + rng.normal()), float(rng.normal())], float(rng.normal())) for i, y in enumerate(rng.integers(0, 2, n))]
    return rows, spark.createDataFrame(rows, "k long, fold int, y int, a array<double>, b double")


def test_ablation_scores_are_those_of_its_variants(spark):
    """The area of each variant is that of its own out-of-fold scores, by brute force; what a block adds is the difference."""
    rows, df = two_classes(spark)
    out = {(r.features, r.block): r for r in models.ablation(df, "k", "y", "fold", [0, 1, 2, 3], {("a", "none"): ["a"], ("a", "b"): ["a", "b"], ("b", "none"): ["b"]}, trees=3).collect()}
    for columns, name in ((["a"], ("a", "none")), (["a", "b"], ("a", "b"))):
        flat, _ = models.feature_blocks(df, [("all", columns)])
        oof, fitted = models.cross_validate(models.vectors(flat), "k", "y", "fold", [0, 1, 2, 3], trees=3)
        scores = {r.k: (r.y, r.oof) for r in oof.collect()}
        positive, negative = ([s for y, s in scores.values() if y == c] for c in (1, 0))
        area = np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p in positive for q in negative])
        assert len(scores) == len(rows) == out[name].n and len(fitted) == 4 and out[name].auroc == pytest.approx(area, abs=1e-9)
    assert out["a", "none"].auroc > 0.6 > out["b", "none"].auroc


def test_out_of_fold_scores_come_from_models_that_have_not_seen_the_row(spark):
    """Exchanging the labels within a fold changes no score of that fold, and does change others."""
    rows, df = two_classes(spark)
    own = [r[2] for r in rows if r[1] == 2]
    turned = iter(own[::-1])
    other = spark.createDataFrame([(k, f, next(turned) if f == 2 else y, a, b) for k, f, y, a, b in rows], df.schema)

    def scores(table):
        flat, _ = models.feature_blocks(table, [("all", ["a"])])
        oof, _ = models.cross_validate(models.vectors(flat), "k", "y", "fold", [0, 1, 2, 3], trees=2)
        return {r.k: r.oof for r in oof.collect()}

    before, after = scores(df), scores(other)
    changed = {rows[k][1] for k in before if before[k] != pytest.approx(after[k], abs=1e-12)}
    assert own != own[::-1] and changed and 2 not in changed


def test_scratch_tables_go_with_their_scope(spark):
    from cribrum.operators.lineage import cut, dropping, scratch, shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    kept = cut(spark.range(3))
    before = set(os.listdir(folder))
    with dropping(spark):
        assert cut(spark.range(5)).count() == 5
        path = scratch(spark, "never-written")
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before and kept.count() == 3 and not os.path.exists(path)
